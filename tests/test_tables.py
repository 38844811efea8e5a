"""Store, streaming, statistics, accents, dialogue and the small functions."""

import math
import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from logsense import session
from logsense.functions import misc, textstats, unicode_norm
from logsense.operators import dialogue
from logsense.operators.logtable import column_values
from logsense.plans import registry
from logsense.sources import store
from logsense.streaming.lines import level_counts, stream_lines, stream_tokens


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_store(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"2024-01-01 00:00:01 INFO 1.2.3.4\r\nplain {}\n\nERROR lone\rcr\n")
    got = store.read_lines(spark, str(tmp_path / "a.log"))
    assert [(r.line_no, r.text) for r in got.orderBy("line_no").collect()] == [(0, "2024-01-01 00:00:01 INFO 1.2.3.4"), (1, "plain {}"), (2, ""), (3, "ERROR lone\rcr")]
    for level in ("fast", "best"):
        store.write(got, str(tmp_path / level), level)
        t = store.read(spark, str(tmp_path / level))
        assert [r.text for r in store.restored(t).orderBy("line_no").collect()] == [r.text for r in got.orderBy("line_no").collect()]
        assert t.query(["ipv4"], "log_levels", "<", "ERROR").first().ipv4 == "1.2.3.4"
    assert t.columns() == ["timestamps", "ipv4", "log_levels"] and t.has_column("ipv4") and not t.has_column("urls")
    assert [r.ipv4 for r in column_values(t.select_columns("ipv4"), "ipv4").collect()] == ["1.2.3.4"]
    size = store.sizes(spark, str(tmp_path / "best")).first()
    assert size.row_count == 4 and size.column_count == 3 and size.original_size == sum(len(r.text.encode()) + 1 for r in got.collect())
    plan = t.query(["timestamps"], "ipv4", "=", "1.2.3.4")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(ipv4_lo,16909060)" in plan and "urls" not in plan
    learned = textstats.learn(got.withColumn("k", F.col("line_no")), ["k"])
    store.save_patterns(learned, str(tmp_path / "patterns"))
    assert sorted(store.load_patterns(spark, str(tmp_path / "patterns")).collect()) == sorted(learned.select("ptype", "count", "examples").collect())
    store.to_csv(t.select_columns("ipv4"), str(tmp_path / "csv"))
    store.to_json(t.select_columns("ipv4"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4 and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4
    assert store.to_table_text(t.select_columns("ipv4")).endswith("(4 rows)")


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.log").write_text("2024-01-01 00:10:00 ERROR a\n2024-01-01 00:20:00 ERROR b 7\n2024-01-01 03:00:00 INFO c\n")
    lines = stream_lines(spark, str(tmp_path / "in"))
    for name, df, mode in (("tok", stream_tokens(lines), "append"), ("lev", level_counts(lines), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("tok").count() == 7
    assert sorted((r.level, r.n) for r in spark.table("lev").collect()) == [("ERROR", 2), ("INFO", 1)]


def test_statistics(spark):
    texts = ["a" * 40, "The quick brown fox 0123", "Hi", "", "2024-01-01 00:00:00 INFO 10.0.0.1 " * 100]
    got = textstats.estimate(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").orderBy("k").collect()
    for r, t in zip(got, texts, strict=True):
        n = len(t)
        h = -sum(t.count(c) / n * math.log2(t.count(c) / n) for c in set(t)) if n else 0
        assert abs(r.shannon_entropy - h) < 1e-9 and r.unique_bytes == len(set(t)) and r.original_size == n
    assert got[3].estimated_size == 42 and got[3].estimated_ratio == 1.0 and got[3].quality == "Not Recommended"
    assert got[4].pattern_coverage > 0.8 and got[4].estimated_ratio < got[1].estimated_ratio


def test_learn(spark):
    df = spark.createDataFrame([(k, f"10.0.0.{k} and 10.0.0.{k}") for k in range(20)], "k long, text string")
    r = textstats.learn(df, ["k"]).first()
    assert (r.ptype, r["count"], r.examples) == ("IPV4", 40, [f"10.0.0.{k}" for k in range(5)])


def test_accents(spark):
    assert len(unicode_norm.COMPOSED) == 87 and all(len(p) == 2 for p in unicode_norm._PAIRS.values())
    text = "Été ñandú çå Äč āă 日本"
    assert one(spark, text, unicode_norm.to_nfd) == unicodedata.normalize("NFD", text)
    assert one(spark, unicodedata.normalize("NFD", text), unicode_norm.to_nfc) == text
    assert one(spark, text, unicode_norm.strip_accents) == "Ete nandu ca Ac aa 日本"
    assert one(spark, unicodedata.normalize("NFD", text), unicode_norm.strip_accents) == "Ete nandu ca Ac aa 日本"
    assert one(spark, "á̧", unicode_norm.to_nfd) == "á̧"
    assert one(spark, text, lambda c: unicode_norm.is_normalized(c, "NFC")) and not one(spark, text, unicode_norm.is_ascii)


def test_small_functions(spark):
    assert one(spark, "aaaa", lambda c: misc.search_count(c, "aa")) == 3
    assert one(spark, "aaaa", lambda c: misc.search_locate(c, "aa")) == [0, 1, 2]
    assert one(spark, "x.fox.y", lambda c: misc.search_locate(c, ".")) == [1, 5]
    assert one(spark, "the fox ran", lambda c: misc.context(c, F.lit(4), 3, 2)) == "e fox r"
    assert one(spark, "abca", misc.charset) == ["a", "b", "c"]
    assert one(spark, bytearray(b"a"), misc.fnv1a, "binary") == 0xAF63DC4C8601EC8C - (1 << 64)
    assert one(spark, "héllo" * 50, lambda c: misc.decompressed(misc.compressed(c))) == "héllo" * 50
    logits = lambda c: misc.ternary_logits(c, [[1, -1, 0], [0, 1, 1]])
    assert one(spark, [1.0, 2.0, 3.0], logits, "array<double>") == [-1.0, 5.0]
    assert one(spark, [5.0, 1.0, 5.0], misc.argmax, "array<double>") == 2


def test_dialogue(spark):
    base = spark.createDataFrame([(0, "A", "ja0"), (1, "B", "ja1"), (5, "A", "ja5")], "id long, speaker string, text string")
    deltas = spark.createDataFrame([(1, 0, "A", "old", 1), (1, 0, "A", "en0", 2), (1, 9, "C", "en9", 3)], "locale int, id long, speaker string, text string, seq int")
    last = dialogue.last_writes(deltas, ["locale", "id"], "seq")
    got = {r.id: r.text for r in dialogue.localized(base, last, 1, 0, ["id"]).collect()}
    assert got == {0: "en0", 1: "ja1", 5: "ja5", 9: "en9"}
    assert {r.id: r.text for r in dialogue.localized(base, last, 0, 0, ["id"]).collect()} == {0: "ja0", 1: "ja1", 5: "ja5"}
    assert [r.locale for r in dialogue.available_locales(last, 3).collect()] == [3, 1]
    assert [(r.name, r.idx) for r in dialogue.speaker_dictionary(base, ["id"]).orderBy("idx").collect()] == [("A", 0), ("B", 1)]
    both = base.withColumn("t", F.lit(1)).unionByName(base.where("id < 2").withColumn("t", F.lit(2)))
    assert {r.t: r.contiguous for r in dialogue.contiguous(both, "t").collect()} == {1: False, 2: True}

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    want = fnv(b"".join(i.to_bytes(4, "little") + t.encode() for i, t in ((0, "ja0"), (1, "ja1"), (5, "ja5"))))
    assert dialogue.content_hash(base.withColumn("t", F.lit(1)), "t").first().content_hash == want


def test_codec_roundtrip_goes_through_the_store(spark, tmp_path, monkeypatch):
    rows = [(1, "10.0.0.1 said 2024-01-02 ERROR"), (1, "10.0.0.1 said 2024-01-02 ERROR"), (2, ""), (None, "x\n7 \u00e9")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = registry.QUERIES["codec_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted((str(r.item_id), r.same) for r in got) == [("1", True), ("1", True), ("2", True), ("None", True)]
    write = store.write
    monkeypatch.setattr(store, "write", lambda lines, *a: write(lines.withColumn("text", F.replace("text", F.lit("ERROR"), F.lit("WARN"))), *a))
    got = registry.QUERIES["codec_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted((str(r.item_id), r.same) for r in got) == [("1", False), ("1", False), ("2", True), ("None", True)]


def test_accents_without_python(spark):
    """Against a loop over characters; with built-in functions, so that a batch of long texts has no copies in a worker."""
    rank = {chr(c): k for first, last, k in unicode_norm.CLASSES for c in range(first, last + 1)}
    pairs = {c: unicodedata.normalize("NFD", c) for c in unicode_norm.COMPOSED}

    def apart(text):
        out, run = [], []
        for c in "".join(pairs.get(c, c) for c in text):
            if c in rank:
                run.append(c)
            else:
                out += [*sorted(run, key=rank.get), c]
                run = []
        return "".join(out + sorted(run, key=rank.get))

    def joined(text):
        text = apart(text)
        for one_, two in ((c, p) for c, p in pairs.items() if not text.isascii()):
            text = text.replace(two, one_)
        return text

    rng = random.Random(3)
    chars = [*"aeioucnzAEZ x$\\\n", *unicode_norm.COMPOSED, *rank, "\u0345", "日", "😀"]
    texts = ["", "\u0301\u0327", "plain", *("".join(rng.choices(chars, k=rng.randint(1, 40))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "k int, v string").select("k", unicode_norm.to_nfd(F.col("v")).alias("d"), unicode_norm.to_nfc(F.col("v")).alias("c"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.orderBy("k").collect()
    assert [(r.d, r.c) for r in got] == [*((apart(t), joined(t)) for t in texts), (None, None)]


def test_byte_counts_of_long_batches(spark):
    texts = ["", None, "aé" * 200_000, "b" * 70_000, *("xy" * k for k in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(1)
    for r in df.select("text", textstats.byte_counts(F.col("text")).alias("n")).collect():
        raw = (r.text or "").encode()
        assert sum(r.n) == len(raw) and all(r.n[b] == raw.count(b) for b in set(raw))
    whole = "".join(t or "" for t in texts).encode()
    assert {r.byte: r.n for r in textstats.byte_totals(df).collect()} == {b: whole.count(b) for b in set(whole)}
    assert "mapInArrow" in textstats.byte_totals(df)._jdf.queryExecution().logical().toString().replace("MapInArrow", "mapInArrow")


def test_tables_are_dealt_out_by_size(spark, tmp_path, monkeypatch):
    """One row group of one file is one task of a scan, however many splits the file has."""
    spark.range(0, 20_000).selectExpr("id AS k", "sha2(string(id), 512) AS h").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    size = sum(p.stat().st_size for p in (tmp_path / "t.parquet").glob("*.parquet"))
    monkeypatch.setattr(session, "SHARE", size // 9)
    rows = session.spread(spark, str(tmp_path), "t").groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= 9 and max(r["count"] for r in rows) < 20_000 / 8


@pytest.mark.parametrize("name", ["charset_by_lang", "charset_merge", "unique_chars"])
def test_characters_of_odd_texts(spark, tmp_path, name):
    """An empty text has the row that SQL gives it, and null none."""
    texts = ["", "", None, "a\x00\u0301😀 ", "ab", "\n"]
    langs = ["en", None, "fr", None, "de", "de"]
    docs = spark.createDataFrame(list(zip(langs, texts, strict=True)), "lang string, text string").coalesce(1)
    pages = docs.selectExpr("text AS html")
    conversations = docs.selectExpr("1L AS conv_id", "0 AS turn", "'user' AS role", "text")
    con = duckdb.connect()
    for table, df in (("documents", docs), ("pages", pages), ("conversations", conversations)):
        df.write.parquet(str(tmp_path / f"{table}.parquet"))
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert list(got) == list(want)
    assert sorted(map(repr, got.itertuples(index=False, name=None))) == sorted(map(repr, want.itertuples(index=False, name=None)))
