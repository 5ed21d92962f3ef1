"""Queries of the corpus operators with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.llm import (chat, decontaminate, line_join, max_sketch, order_minhash, packing, quality, rollups, runs, sharding,
                           token_files, vptree, warc)
from loginlens.llm.common import div, fingerprint, table, with_row_id
from loginlens.session import durable, run_dir


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; the files are installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_id(table(spark, sf_dir, "documents"))
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "alignments")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources; a source's languages are its paths."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = durable(quality.with_evidence(docs.select("doc_id", "source", "lang", "text"), model).drop("text"))
    sites = quality.site_rates(scored, "source", "lang", model)
    return quality.decide(scored, sites, "source", "lang").drop("_host", "_path")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_row_id(table(spark, sf_dir, "documents")).select("_row", "doc_id", "text")
    return order_minhash.groups(rows).drop("_row")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of one corpus: all documents come in, repeats go, then all are counted with a newer tokenizer.

    The last two batches are committed twice, as a job that is run again would.
    """
    old, new = "byte_bpe_50k", "word_bpe_49k"
    docs = with_row_id(table(spark, sf_dir, "documents")).select("_row", "doc_id", "source", "lang", "text")
    counted = rollups.count_with(docs.withColumn("same", fingerprint("text")), [
        (tokenizer(f"{old}.json"), "bytes", "n_old"), (tokenizer(f"{new}.json"), "words", "n_new")],
        ["same", "_row", "doc_id", "source", "lang"])
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")  # null ids come last
    counted = durable(counted.select("same", place.alias("place"), "source", "lang", "n_old", "n_new"))
    first = counted.groupBy("same").agg(F.min("place").alias("kept"), F.count("*").alias("copies"))
    repeats = counted.join(first.where("copies > 1").select("same", "kept"), "same").where(
        F.col("place._row") != F.col("kept._row"))
    # Rows that share a text tell themselves apart by their row id, which is never null.
    remaining = counted.join(first.select("same", "kept"), "same").where(
        F.col("place._row") == F.col("kept._row"))
    store = rollups.Rollup(spark, run_dir(spark, "rollup"))
    store.commit("0001-insert", counted.select(*rollups.change(1, F.col("n_old"), old)))
    for _ in range(2):
        store.commit("0002-delete", repeats.select(*rollups.change(-1, F.col("n_old"), old)))
        store.commit("0003-revise", remaining.select(*rollups.change(-1, F.col("n_old"), old)).unionByName(
            remaining.select(*rollups.change(1, F.col("n_new"), new))))
    store.compact()
    return store.totals()


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, run_dir(spark, "tokens"), tokenizer("word_bpe_49k.json"),
                                             cut="words", end_id=1, vocabulary_size=49_408)
    return token_files.read_token_files(manifest)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    encoded = packing.encode_documents(docs, tokenizer("byte_bpe_50k.json"), cut="bytes", end_id=0,
                                       vocabulary_size=50_257)
    return packing.pack(encoded, width=2)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at this factor is measured against brute force in the tests."""
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vptree.build_index(vectors), vectors.where("vec_id % 20 = 0"), k=20, factor=0.9)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line: its document and number, its class of equal lines, and how many other lines are linked."""
    rows = with_row_id(table(spark, sf_dir, "documents")).select("_row", "doc_id", "text")
    return line_join.judged_lines(rows).drop("_row").withColumnRenamed("at", "line_no")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = max_sketch.build_index(table(spark, sf_dir, "documents"))
    return max_sketch.search(index, table(spark, sf_dir, "benchmark"), k=10)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's checksum ends in 0 are made periodic first; null ids are left as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", div(h, 10).alias("g"), F.when(
        h % 10 == 0, F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")).alias("words"))
    placed = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + div(F.col("n") - F.col("a"), 3 + F.col("g") % 8)).cast("int"))
    again = F.expr("flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int)))")
    periodic = F.array_join(F.concat(F.expr("slice(words, 1, a)"), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    made = placed.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))
    found = runs.with_runs(made)
    first = F.expr("""array_sort(runs, (l, r) -> CASE
        WHEN l.length * r.period <> r.length * l.period THEN IF(l.length * r.period > r.length * l.period, -1, 1)
        WHEN l.start <> r.start THEN IF(l.start < r.start, -1, 1)
        WHEN l.period <> r.period THEN IF(l.period < r.period, -1, 1) ELSE 0 END)[0]""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, first).alias("best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.*", div(1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written and read back; what a page is called comes from its metadata record, joined to its capture."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), run_dir(spark, "warc"))
    return pages_of(warc.assemble(warc.read_records(manifest, payload=False)))


def pages_of(captures: DataFrame) -> DataFrame:
    """Per capture its page and, for a revisit, the page of the response that it names."""
    named = F.filter("metadata", lambda m: F.try_element_at(m["fields"], F.lit("page-id")).isNotNull())
    page = F.when(F.size(named) > 0, F.element_at(F.element_at(named, 1)["fields"], "page-id").cast("long"))
    flat = durable(captures.where("capture IS NOT NULL").select(
        page.alias("page_id"), "capture.payload_bytes", "capture.payload_digest", F.col("capture.type").alias("record_type"),
        "capture.record_id", "capture.refers_to"))
    responses = flat.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("named"))
    revisits = warc.join_unique(flat.where("record_type = 'revisit'"), responses, "refers_to")
    plain = flat.where("record_type <> 'revisit'").withColumn("named", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", F.col("named").alias("refers_to")]
    return plain.select(*columns).unionByName(revisits.select(*columns))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_order_minhash": op4_order_minhash,
    "op5_token_rollup": op5_token_rollup,
    "op6_token_files": op6_token_files,
    "op7_packing": op7_packing,
    "op8_nearest": op8_nearest,
    "op9_line_dedup": op9_line_dedup,
    "op10_sharding": op10_sharding,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc": op13_warc,
}
ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op11_lexical_search": max_sketch.ORACLE,
    "op13_warc": warc.ORACLE,
}
