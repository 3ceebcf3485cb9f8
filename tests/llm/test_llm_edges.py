"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import chat, decontaminate, html, imatch, langid, neardup, packing, pii, rlz, warc

LONG = "le mot juste " * 40_000 + "fin"
TEXTS = [(1, None, "en"), (2, "", "fr"), (3, " \n\t ", None), (4, LONG, "fr"), (4, LONG, "fr"), (5, "one word", "en"), (None, "one word", "en"), (6, "x" * 50_000, None), (7, "é" * 10 + "\x00\x01 ok", "en"), (8, "tie tie tie", "en"), (9, "tie tie tie", "en"), (10, "￿ a@b.co ￾", "en")]
SCHEMA = "doc_id long, text string, lang string"
CLASH = ["row", "class", "score", "lang_pred", "held_out", "key", "component_id", "pii_spans", "__row", "__lang", "__score", "__text", "__digit", "__email", "n_chars", "source", "sequence_id", "host", "value"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).withColumn("n_chars", F.length("text").cast("long")).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Tom has 5 apples and gives 2 of them to his friend Ann today"), (2, None), (3, ""), (4, "tie tie tie"), (1, "Tom has 5 apples and gives 2 of them to his friend Ann today")], "item_id long, text string").withColumn("hash", F.lit("x"))


PER_ROW = {"rlz": rlz.cut, "langid": langid.identify, "pii": pii.find, "imatch": imatch.compare, "neardup": neardup.near_duplicates}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row(spark, docs, name):
    assert PER_ROW[name](docs).count() == len(TEXTS)
    assert PER_ROW[name](docs.limit(0)).count() == 0


def test_values_of_odd_rows(docs):
    r = {x["doc_id"]: x for x in rlz.cut(docs, digest=True).collect()}
    assert (r[1]["n_words"], r[2]["n_words"], r[3]["n_words"]) == (0, 0, 0) and r[1]["kept"] == hashlib.sha256(b"").hexdigest()
    assert (r[4]["n_words"], r[4]["n_removed"]) == (120_001, 0)  # both rows are of one doc_id
    r = {x["doc_id"]: x for x in langid.identify(docs).collect()}
    assert [r[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and r[4]["lang_pred"] in ("en", "fr") and 0 <= r[4]["score"] <= 1
    r = {x["doc_id"]: x for x in pii.find(docs).collect()}
    assert r[10]["spans"] == "email:2:8" and r[1]["spans"] == "" and r[6]["n_email"] == 0
    n = {x["doc_id"]: x for x in neardup.near_duplicates(docs).collect()}
    assert [n[i]["n_shingles"] for i in (1, 2, 3, 4, 5, 8)] == [0, 0, 0, 4, 1, 1]
    assert [n[i]["component_id"] for i in (1, 2, 3, 8, 9)] == [1, 2, 3, 8, 8] and n[None]["component_id"] is None and n[None]["kept"]
    f = {x["doc_id"]: x for x in imatch.compare(docs).collect()}
    assert f[8]["fingerprint"] == f[9]["fingerprint"] and f[8]["near_next"] == 1.0 and f[5]["fingerprint"] == f[None]["fingerprint"] and f[1]["fingerprint"] == f[2]["fingerprint"]


def test_filters_keep_columns_and_clean_rows(docs, items):
    for keep, n in ((lambda d: langid.keep_known(d), 9), (neardup.keep_first, 10), (lambda d: decontaminate.keep_clean(d, items), 12), (pii.redact, 12)):
        out = keep(docs)
        assert out.columns == docs.columns
        assert out.count() == n
        assert {r["__row"] for r in out.select("__row").collect()} == {"own __row"} and {r["score"] for r in out.select("score").collect()} == {"own score"}
        assert keep(docs.limit(0)).count() == 0


def test_packing(docs):
    rows = packing.pack(docs).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert {r["doc_tokens"] for i in (1, 2) for r in by_doc[i]} == {1}
    assert sum(r["length"] for r in by_doc[4]) == 2 * by_doc[4][0]["doc_tokens"] and None in by_doc
    assert packing.pack(docs.limit(0)).count() == 0


def test_pages(spark):
    big = "<article><p>" + "w " * 100_000 + "</p></article>"
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "<p>open <b>bold"), (4, "http://h/x", big), (4, "http://h/x", big), (None, "http://h/y\r\nX: y", "<article>a &amp; b<script>x</script></article>"), (5, "http://h/z", "<" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "paths", "text", "payload", "record_type")})
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert got[1] == got[2] == "" and got[3] == "open bold" and got[None] == "a & b" and len(got[4]) == 199_999
    assert html.extract(pages.limit(0)).count() == 0
    records = warc.deduplicate(warc.to_records(pages))
    path = warc.new_path(spark, "w")
    warc.write_archive(records, path)
    back = {(r["page_id"], r["record_type"]): r for r in warc.resolve_revisits(warc.read_archive(spark, path)).collect()}
    assert len(back) == 6 and back[1, "response"]["payload_bytes"] == 0 and back[None, "response"]["payload_bytes"] == len(rows[5][2])
    assert warc.deduplicate(warc.to_records(pages.limit(0))).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|end|>\n<\\|x"), (2, 0, None, "?"), (None, 0, "user", "a"), (None, 0, "user", "a"), (3, 0, "assistant", "first"), (4, 0, "user", "q"), (4, 0, "assistant", "tie"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "y" * 300_000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"valid": F.lit(1), "segments": F.lit(1)})
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(c)).collect()}
    assert got[1]["loss_chars"] == 12 and got[1]["valid"] and not got[2]["valid"] and got[None]["n_turns"] == 2 and not got[3]["valid"] and got[5]["valid"] and got[5]["loss_chars"] == 300_000
    assert got[4]["turns_sha256"] == hashlib.sha256(b"assistant\ntie\nuser\nq\n").hexdigest()
    assert chat.read_back(chat.format_turns(c.limit(0))).count() == 0


def test_stages(spark, docs, items, tmp_path):
    items.select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, docs.limit(0)):
        d = start
        for name, stage in corpus_pipeline.STAGES:
            before, d = d, stage(spark, d, str(tmp_path))
            if name != "packing":
                assert d.columns == before.columns and d.count() <= before.count()
        assert d.columns[0] == "doc_id"
