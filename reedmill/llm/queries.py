"""The pN_ queries: the operators of this folder over the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.script import tidy_label
from ..session import table
from . import copies, defects, entities, leaks, mixing, overlap, packing, tokens, wordsalad


def _overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(
        table(spark, d, "bird_gold"), table(spark, d, "bird"), eval_id="gold_id", eval_texts=[["text"], ["ctx"], ["ctx", "text"]], train_id="bird_id", train_text="text"
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap_pairs(spark, d).select("gold_id", "bird_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(
        _overlap_pairs(spark, d), table(spark, d, "bird_gold"), table(spark, d, "bird"), eval_id="gold_id", eval_split="split", train_id="bird_id", train_source="source"
    )


def _formatted(spark: SparkSession, d: str) -> DataFrame:
    return copies.keyed([("synthetic", table(spark, d, "synthetic"), "syn_id", ["text"]), ("bird", table(spark, d, "bird"), "bird_id", ["ctx", "text"])])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_formatted(spark, d))


def p4_collapse(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(_formatted(spark, d))


def _entity_rows(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "translation_pairs").select(F.col("pair_id").alias("id"), F.array(entities.entity_key(F.col("eng_id"), F.lit(False))).alias("keys"), "split")
    chats = table(spark, d, "sft_train").select(
        F.col("ex_id").alias("id"), F.array(entities.entity_key(F.col("id"), F.coalesce(F.col("mode").isin("continuation", "topic"), F.lit(False)))).alias("keys"), "split"
    )
    return pairs.unionByName(chats)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.split_breaks(_entity_rows(spark, d))


def _few(df: DataFrame, most: int = 100_000) -> list:
    """The rows of a table of targets; more than the driver should hold are an error, none is dropped."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} targets")
    return rows


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    return [(r["split"], r["target_share"]) for r in _few(table(spark, d, "split_targets").orderBy(F.desc("target_share"), "split"))]


def p5_assign(spark: SparkSession, d: str) -> DataFrame:
    return entities.assign_splits(_entity_rows(spark, d), _targets(spark, d))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    per = p5_assign(spark, d).groupBy("new_split").agg(F.count("*").alias("n_rows"), F.countDistinct("root").alias("n_groups"))
    total = per.agg(F.sum("n_rows").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("new_split", "n_rows", "n_groups", (F.col("n_rows") / F.col("total")).alias("share"))  # one row a split


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p5_found, each once, with the number of rows of its entity in other splits."""
    return entities.break_members(_entity_rows(spark, d)).select("id", "split", "n_elsewhere")


def p5_forest(spark: SparkSession, d: str) -> DataFrame:
    """Size of the persisted spanning forest: linked rows, edges, trees."""
    forest = entities.forest_table(_entity_rows(spark, d))
    ends = forest.select(F.explode(F.array("u", "v")).alias("x")).agg(F.countDistinct("x").alias("n_rows"))
    edges = forest.agg(F.count("*").alias("n_edges"))  # one row each
    return ends.crossJoin(F.broadcast(edges)).select("n_rows", "n_edges", (F.col("n_rows") - F.col("n_edges")).alias("n_trees"))


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rows, entities and torn entities of the new splits; none may be torn."""
    per = p5_assign(spark, d).groupBy("root").agg(F.count("*").alias("n"), F.countDistinct("new_split").alias("splits"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_entities"), F.count_if(F.col("splits") > 1).alias("n_torn"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, replies = table(spark, d, "translation_pairs"), table(spark, d, "bird_english")
    toki = defects.Pairs(pairs, tab="translation_pairs", row_id="pair_id", question="en", answer="tp", toki=True, other_texts=replies.select(F.col("reply_en").alias("text")))
    english = defects.Pairs(replies, tab="bird_english", row_id="be_id", question="scene_en", answer="reply_en", toki=False, other_texts=pairs.select(F.col("tp").alias("text")))
    return defects.defects_of([toki, english])


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """tab, id, source (tidy), n_tokens of the rows that can be mixed."""
    chats, lines = table(spark, d, "sft_train"), table(spark, d, "bird")
    label = lambda tab, row_id: {"tab": F.lit(tab), "id": F.col(row_id).cast("long"), "source": tidy_label(F.col("source"))}
    said = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return tokens.document_tokens(chats, said, label("sft_train", "ex_id")).unionByName(
        tokens.document_tokens(lines, F.concat_ws("\n", F.nullif(F.col("ctx"), F.lit("")), F.col("text")), label("bird", "bird_id"))
    )


def _language(lang: Column) -> Column:
    """One label a language: toki is an old label of tok."""
    tidy = tidy_label(lang)
    return F.when(tidy.isin("toki", "toki-pona", "tp"), "tok").when(tidy.isin("english", "eng"), "en").otherwise(tidy)


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of corpus_filtered by source, language and domain, and of synthetic by source."""
    corpus, made = table(spark, d, "corpus_filtered"), table(spark, d, "synthetic")
    none = F.lit(None).cast("string")
    keep = {"tab": F.lit("corpus_filtered"), "id": F.col("ord"), "source": tidy_label(F.col("source")), "lang": _language(F.col("lang")), "domain": tidy_label(F.col("domain"))}
    a = tokens.document_tokens(corpus, F.col("text"), keep)
    b = tokens.document_tokens(made, F.col("text"), {"tab": F.lit("synthetic"), "id": F.col("syn_id"), "source": tidy_label(F.col("source")), "lang": none, "domain": none})
    return tokens.slice_totals(a.unionByName(b), ["tab", "source", "lang", "domain"])


def p2_slice_docs(spark: SparkSession, d: str) -> DataFrame:
    """The slices of p2_token_budget with their documents, and how many of them have neither text nor tokens."""
    return p2_token_budget(spark, d).select("tab", "source", "lang", "domain", "n_docs", "n_empty")


def p2_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.document_tokens(table(spark, d, "documents"), F.col("text"), {"doc_id": F.col("doc_id")})


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in _few(table(spark, d, "mix_targets").orderBy("source"))]
    return mixing.mix(_sizes(spark, d), targets)


def p3_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(_mixed(spark, d), table(spark, d, "mix_targets"))


def p3_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rows used too often, parts used twice in a pass and sources without a target; the result has to be zeros."""
    mixed, goal = _mixed(spark, d), table(spark, d, "mix_targets").select("source", "max_repeats")
    uses = mixed.groupBy("source", "tab", "id", "begin", "use_no").agg(F.count("*").alias("n"))
    rows = uses.groupBy("source", "tab", "id").agg(F.countDistinct("use_no").alias("uses"), F.max("n").alias("twice")).join(goal, "source", "left")
    return rows.agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("n_overused"), F.count_if(F.col("twice") > 1).alias("n_twice"), F.count_if(F.col("max_repeats").isNull()).alias("n_stray"))


CAPACITY = 2048


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(p2_document_tokens(spark, d), item_id="doc_id", size="n_tokens", capacity=CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, d), CAPACITY)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents, overfull containers, and documents divided though they fit; there may be none of the last two."""
    packed = p7_pack(spark, d)
    per_doc = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("t"))
    docs = per_doc.agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= CAPACITY)).alias("n_divided"))
    used = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > CAPACITY).alias("n_overfull"))
    return docs.crossJoin(F.broadcast(used))  # one row each


def p7_tiers(spark: SparkSession, d: str) -> DataFrame:
    """How each tier of context size is packed and filled."""
    return packing.tier_report(p7_pack(spark, d), CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), doc_id="doc_id", text="text", item_id="item_id", item_text="text")
    return found.select("item_id", "doc_id")


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Leaks and passages of much the same wording: at least 0.6 of the shorter side in common order."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), doc_id="doc_id", text="text", item_id="item_id", item_text="text", paraphrase=0.6)
    return found.where("share >= 0.6").select("item_id", "doc_id", "kind", "share")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return wordsalad.spam_pages(wordsalad.salad_scores(table(spark, d, "documents"), "doc_id", "text")).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = wordsalad.salad_scores(table(spark, d, "documents"), "doc_id", "text")
    return scores.withColumns({c: F.round(c, 6) for c in ("coherence", "salad_share", "repeated_share")})


def p9_incoherent(spark: SparkSession, d: str) -> DataFrame:
    """What the PMI stage alone says, without the exact check: more than half of the words in incoherent blocks or links."""
    return wordsalad.incoherent(wordsalad.salad_scores(table(spark, d, "documents"), "doc_id", "text"), 0.5, 1.0).select("doc_id")


QUERIES = {
    q.__name__: q
    for q in (
        p1_found, p1_report, p2_token_budget, p2_slice_docs, p2_document_tokens, p3_mix, p3_shares, p3_invariants, p4_found, p4_collapse, p5_found, p5_members, p5_forest, p5_assign, p5_shares, p5_invariants, p6_found, p7_pack, p7_fill, p7_tiers, p7_invariants,
        p8_found, p8_paraphrases, p9_found, p9_scores, p9_incoherent,
    )
}
