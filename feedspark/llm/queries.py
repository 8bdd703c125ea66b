"""The registered queries of the operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.llm import brown_lm, chat, decontam, langmix, linkgraph, mixing, ngram_join, packing, pii, quality, repair, spelling, toxicity
from feedspark.llm.common import stored, table, tokenizer_path
from feedspark.llm.sql import chat_sql, jaccard_sql, mixing_sql, quality_sql, repair_sql, spelling_sql
from feedspark.plans.registry import Registry

R = Registry()


@R.query("op4_quality", quality_sql())
def op4_quality(spark, sf_dir):
    docs = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("broken_rules", ",").alias("broken_rules"),
    )


@R.query("op3_ngram_join", jaccard_sql())
def op3_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@R.query("op10_decontam")
def op10_decontam(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@R.query("op1_pii")
def op1_pii(spark, sf_dir):
    docs = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(list(kinds)))
    return docs.select(
        "doc_id",
        *[F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.listed(of(pii.BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@R.query("op6_packing")
def op6_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@R.query("op7_chat", chat_sql())
def op7_chat(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    added = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', :t), (-1L, 1L, 'assistant', :t) AS x(conv_id, turn, role, text)",
        {"t": own},
    )
    return chat.digests(chat.examples(given.unionByName(added)))


@R.query("op8_urltrust")
def op8_urltrust(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return linkgraph.filtered(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@R.query("op2_brown_lm")
def op2_brown_lm(spark, sf_dir):
    return brown_lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


@R.query("op5_langmix")
def op5_langmix(spark, sf_dir):
    answers = langmix.identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return answers.select("doc_id", "held_out", "lang_pred", "score", "languages")


@R.query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@R.query("op11_mixing", mixing_sql())
def op11_mixing(spark, sf_dir):
    rows = stored(mixing.drawn(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return mixing.mixed(rows, mixing.planned(rows))


@R.query("op12_spelling", spelling_sql())
def op12_spelling(spark, sf_dir):
    return spelling.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


@R.query("op13_repair", repair_sql())
def op13_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.reported(conversations, repair.damaged(conversations))
