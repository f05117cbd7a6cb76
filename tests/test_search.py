import pytest
from pyspark.sql import functions as F

from folioscan.functions.fold import fold, fold_text, table
from folioscan.operators import expand, filters, rank
from folioscan.operators.occurrences import merge_islands, merged
from folioscan.operators.snippets import context_of, shown, snippets
from folioscan.plans.index import TextIndex, index_of
from folioscan.plans.querylang import QueryError
from folioscan.plans import search as search_module
from folioscan.plans.search import Options, Searcher

TEXTS = {
    1: ["QATREE-deep", "second page about the annual budget"],
    2: ["都市計畫委員會"],
    3: ["都市计画说明"],
    4: ["教師升等級審查"],
    5: ["教師升級等待審查"],
    6: ["outstanding results were outstandings"],
    7: ["run fast on the runway"],
    8: ["C++ and B+ at 100% a/b snake_case"],
    9: ["丁", "戊"],
    10: ["budget " * 7],
    11: ["budget reviewed by the committee; weekly reviews follow"],
    12: ["Café Éclair", "𠀀计画 x"],
    13: [],
    14: ["foo1 budgets"],
}
NAMES = {1: "Alpha Report.PDF", 2: "會議紀錄.docx", 3: "会议纪录.txt"}


@pytest.fixture(scope="module")
def s(spark, tmp_path_factory):
    docs = [(i, f"/srv/Share/{'a' if i % 2 else 'b'}/drafts/{NAMES.get(i, f'file{i}.txt')}", NAMES.get(i, f"file{i}.txt"), NAMES.get(i, "x.txt").rpartition(".")[2].lower(), 100 * i, 1000.0 * i, 500.0 * i, "success", [], "1") for i in TEXTS]
    d = spark.createDataFrame(docs, "doc_id long, path string, filename string, file_type string, file_size long, mtime double, ctime double, parse_status string, warnings array<struct<code:string,location:string,message:string>>, parser_version string")
    segs = [(i * 100 + n, i, str(n + 1), "page", t, [(0, 3, "page", f"p{n}"), (3, 999, "page", f"p{n}b")]) for i, ts in TEXTS.items() for n, t in enumerate(ts)]
    g = spark.createDataFrame(segs, "segment_row_id long, doc_id long, segment_id string, segment_type string, content string, sources array<struct<start:int,end:int,kind:string,location:string>>")
    return Searcher(d.cache(), g.cache(), 7, TextIndex.build(g, str(tmp_path_factory.mktemp("ix") / "v")))


def found(s, text, **options):
    """By the index and by a scan, with the same ranks."""
    a, b = ({r[0]: (round(r[1], 9), r[2]) for r in x.ranked(text, Options(**options)).collect()} for x in (s, Searcher(s.documents, s.segments, s.revision)))
    assert a == b
    return sorted(a)


@pytest.mark.parametrize(
    "text,docs",
    [
        ("QATREE-deep", [1]), ("計畫", [2, 3, 12]), ("计画", [2, 3, 12]), ("升等", [4]), ("丁 戊", []), ("丁 OR 戊", [9]), ("C++", [8]), ("100%", [8]), ("B+", [8]), ("a/b", [8]),
        ("outstanding", [6]), ("running", [7]), ("budget", [1, 10, 11, 14]), ("udge", []), ("ud", [1, 10, 11, 14]), ("foo", []), ("foo1", [14]), ('"reviewed by"', [11]), ("review weekly", [11]),
        ("budget NOT committee", [1, 10, 14]), ("NOT budget", [2, 3, 4, 5, 6, 7, 8, 9, 12, 13]), ("filename:會議", [2, 3]), ("filename:alpha", [1]), ("éclair", [12]), ("eclair", []), ("", []),
    ],
)
def test_queries(s, text, docs):
    assert found(s, text) == docs


def test_options(s):
    assert found(s, "BUDGET", match_case=True) == [] and found(s, "budget", whole_word=True) == [1, 10, 11]
    assert found(s, "outstanding", match_case=True) == [6]
    assert found(s, r"bud\w+s", regex=True) == [14] and found(s, "budget", type_filter="pdf") == [1]
    assert found(s, "budget", min_size=1000, max_size=1100) == [10, 11] and found(s, "budget", modified_after=11000.0, modified_before=14000.0) == [11]
    assert found(s, "budget", include_paths=["/SRV/share/a"]) == [1, 11] and found(s, "budget", exclude_patterns=["drafts"]) == []
    with pytest.raises(QueryError) as e:
        found(s, "(", regex=True)
    assert e.value.code == "regex_syntax"


def test_pages_and_cursors(s):
    first = s.page("budget", Options(limit=2))
    second = s.page("budget", Options(limit=2), first.next_cursor)
    ids = [i["doc_id"] for i in first.items + second.items]
    assert len(set(ids)) == 4 and first.has_more and not second.has_more and second.next_cursor is None and first.total_documents == 4
    assert [i["rank_score"] for i in first.items + second.items] == sorted(i["rank_score"] for i in first.items + second.items)
    by = {i["doc_id"]: i for i in first.items + second.items}
    assert by[10]["total_matches"] == 7 and "<mark>budget</mark>" in by[1]["segments"][0]["snippets"][0]
    with pytest.raises(QueryError) as e:
        s.page("other", Options(limit=2), first.next_cursor)
    assert e.value.code == "stale_cursor"
    with pytest.raises(QueryError):
        Searcher(s.documents, s.segments, 8).page("budget", Options(limit=2), first.next_cursor)


def test_locations_and_context(s):
    page = s.match_locations("budget", 10, offset=2, limit=3)
    assert page["total"] == 7 and [x["ordinal"] for x in page["locations"]] == [3, 4, 5] and page["has_more"]
    one = s.match_locations("QATREE", 1)["locations"][0] if s.match_locations("QATREE", 1)["locations"] else s.match_locations("QATREE-deep", 1)["locations"][0]
    assert one["source_kind"] == "range" and one["location"] == "p0 → p0b"
    assert s.match_context(1001 - 1, 0, 6)["html"].startswith("<mark>budget</mark>")


def test_positives_leave_out_the_negated(s):
    rows = s.located("budget NOT annual").collect()
    assert all(t == "budget" for r in rows for x in r["spans"] for t in x["terms"])


def lit(*terms):
    return [{"kind": "literal", "term": t, "pattern": t, "flags": 0} for t in terms]


@pytest.mark.parametrize("text,terms,n", [("甲甲甲甲甲", ["甲甲甲"], 1), ("會議會議", ["會議"], 2), ("會議公開", ["會議", "議公"], 1), ("aaa", ["x"], 0), ("", ["a"], 0)])
def test_merging(spark, text, terms, n):
    assert len(merged(text, lit(*terms))) == n


def test_offsets_are_code_points(spark):
    assert [(a, b) for a, b, _ in merged("😀都市計畫計畫", lit("都市計畫", "計畫", "计画"))] == [(1, 5), (5, 7)]
    assert len(merged("aaa", [{"kind": "regex", "term": "z", "pattern": "(?=a)"}])) == 3
    df = spark.createDataFrame([(1, 1, 5), (1, 3, 7), (1, 7, 9), (1, 9, 9), (1, 9, 9)], "k int, start int, end int")
    assert sorted((r["start"], r["end"]) for r in merge_islands(df, ["k"]).collect()) == [(1, 7), (7, 9), (9, 9)]


def test_snippets(spark):
    text = "x" * 200 + "<hit>" + "y" * 200 + "<hit>" + "z" * 10
    rows = [(text, [(200, 205), (405, 410)]), ("abc", [(1, 1)]), ("a" * 900, [(0, 5), (20, 30), (400, 800), (890, 895)]), (None, []), ("none", [])]
    df = spark.createDataFrame(rows, "content string, spans array<struct<start:int,end:int>>")
    out = [r[0] for r in df.select(snippets("content", "spans")).collect()]
    assert len(out[0]) == 2 and "<mark>&lt;hit&gt;</mark>" in out[0][0] and out[0][0].startswith("...") and out[0][1].endswith("z")
    assert out[1] == ['a<span class="zero-width">│</span>bc'] and out[4] == [] and not out[3]
    assert len(out[2]) == 3 and out[2][0].count("<mark>") == 2 and out[2][1] == "..." + "a" * 60 + "<mark>" + "a" * 360 + "</mark>..."
    for (t, spans), got in zip(rows[:2], out):
        assert got[0] == shown(t, max(spans[0][0] - 60, 0), min(len(t), spans[0][1] + 60), spans)
    assert context_of("abcdef", 2, 3, context=1)["text"] == "bcd"
    with pytest.raises(ValueError):
        context_of("a", 0, 1, context=5000)


def test_folding(spark):
    a, b = table(spark)
    assert len(a) == len(b) > 2500 and fold_text("計畫會議記錄", spark) == "计画会议记录"
    assert fold_text(fold_text(a, spark), spark) == fold_text(a, spark)
    assert spark.createDataFrame([("發髮",)], "t string").select(fold("t", spark)).first()[0] == "发发"


def test_filters(spark):
    df = spark.createDataFrame([("/a/b/c.txt",), ("/a/bc/c.md",), ("/A/B/temp/x.csv",)], "path string")
    get = lambda c: [r[0] for r in df.where(c).collect()]
    assert get(filters.include_paths(["/a/b"])) == ["/a/b/c.txt", "/A/B/temp/x.csv"]
    assert get(filters.exclude(["temp"])) == ["/a/b/c.txt", "/a/bc/c.md"] and get(filters.exclude(["*.md", "/a/b/"])) == []
    assert [r[0] for r in df.select(filters.relative("path", ["/a", "/a/b"])).collect()] == ["/c.txt", "/bc/c.md", "/temp/x.csv"]
    assert filters.custom_size(1, 2, "MB") == (1 << 20, 2 << 20)
    with pytest.raises(ValueError):
        filters.custom_size(3, 2, "MB")


def test_expansion(spark):
    g = spark.createDataFrame([(1, 10, "coverage analysis of PROJECT-7429"), (2, 20, "seminar"), (3, 30, None)], "doc_id long, segment_row_id long, content string")
    v = expand.vocabulary(g)
    assert [r[0] for r in expand.near_words(v, "coverge").collect()] == ["coverage"] and expand.near_words(v, "x1").count() == 0
    assert expand.synonyms("Meeting", {"meeting": ["seminar", "會議"]}) == ["seminar", "會議"]
    assert {r["doc_id"] for r in expand.expansion_hits(g, ["seminar"]).collect()} == {2}
    exact = spark.createDataFrame([(5, -2.0), (6, -1.0)], "doc_id long, rank_score double")
    sem = spark.createDataFrame([(7, 1, 0.9), (6, 2, 0.8)], "doc_id long, passage long, score double")
    out = {r["doc_id"]: r for r in expand.fused(exact, expand.expansion_hits(g, ["seminar"]), sem).collect()}
    assert out[5]["score"] == pytest.approx(1 / 61) and out[6]["score"] == pytest.approx(2 / 62) and out[2]["score"] == pytest.approx(0.001)
    assert out[6]["rank_score"] < out[7]["rank_score"] and out[6]["matched_by"] == ["exact", "semantic"]
    assert expand.simple_query("a b") and not expand.simple_query("a AND b")


def test_bm25_formula(spark):
    import math

    g = spark.createDataFrame([(1, "a b budget"), (2, "budget budget"), (3, "c d e f"), (4, "x")], "segment_row_id long, content string")
    out = {r[0]: r[1] for r in rank.bm25(g, {"0": "budget"}).select("segment_row_id", "rank").collect()}
    assert out[3] == 0 and out[2] == pytest.approx(-max(math.log(2.5 / 2.5), 1e-6) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / 2.5)))


def test_index(spark, tmp_path):
    rows = [(1, 1, "Alpha 會議 alphas"), (2, 1, None), (3, 2, "running 2019")]
    ix = TextIndex.build(spark.createDataFrame(rows, "segment_row_id long, doc_id long, content string"), str(tmp_path / "ix"))
    got = {(r["term"], r["segment_row_id"], r["tf"]) for r in ix.postings().collect()}
    assert got == {("alpha", 1, 2), ("会", 1, 1), ("议", 1, 1), ("会议", 1, None), ("run", 3, 1), ("2019", 3, 1)}
    assert [r["positions"] for r in ix.postings(["alpha"]).collect()] == [[0, 3]] and ix.postings(["none"]).count() == 0
    assert ix.counts(["alpha", "none"]) == {"alpha": 1, "none": 0} and ix.words_of("runs") == ["running", "runs"]
    assert ix.meta["segments"] == 3 and ix.meta["mean"] == pytest.approx((3 + 4 + 2 + 2) / 3)
    empty = TextIndex.build(spark.createDataFrame([], "segment_row_id long, doc_id long, content string"), str(tmp_path / "none"))
    assert empty.postings(["x"]).count() == 0 and empty.words_of("a") == ["a"]


def test_a_table_that_changes_gets_another_index(spark, tmp_path):
    path = str(tmp_path / "segments")
    spark.createDataFrame([(1, 1, "alpha")], "segment_row_id long, doc_id long, content string").write.parquet(path)
    assert index_of(spark, path).counts(["alpha"]) == {"alpha": 1}
    spark.createDataFrame([(2, 2, "alpha beta")], "segment_row_id long, doc_id long, content string").write.mode("append").parquet(path)
    assert index_of(spark, path).counts(["alpha", "beta"]) == {"alpha": 2, "beta": 1}


def test_chunks():
    from folioscan.operators.chunks import bounds

    assert bounds("a" * 1000) == [(0, 1000)] and bounds("") == []
    text = ("x" * 99 + "。") * 30
    out = bounds(text)
    assert out[0] == (0, 800) and out[-1][1] == len(text) and all(b - a <= 1000 for a, b in out)
    assert all(c < b and b - c == round(0.15 * (b - a)) for (a, b), (c, _) in zip(out, out[1:]))
    assert max(b - a for a, b in bounds("word " * 500, fits=lambda t: len(t.split()) <= 50)) <= 250


def test_filename_hits_and_scopes(s, tmp_path):
    page = s.page("filename:alpha")
    assert page.items[0]["segments"][0]["location_type"] == "檔名" and "<mark>Alpha</mark>" in page.items[0]["segments"][0]["snippets"][0]
    inside = s.documents.where(expand.in_scope({"file_type": "pdf", "path": "/srv/share/a"}))
    assert [r["doc_id"] for r in inside.collect()] == [1]
    shown = {}
    for r in expand.passages(s.segments, ["budget"]).collect():
        shown.setdefault(r["doc_id"], []).append(r)
    assert len(shown[10]) == 1 and shown[11][0]["text"].startswith("budget reviewed") and [x["location"] for x in shown[11][0]["sources"]] == ["p0", "p0b"]


def test_result_sorts(s):
    rows = s.documents.withColumn("hits", F.col("doc_id") % 3)
    first = lambda by, **k: [r["doc_id"] for r in rank.sorted_results(rows, by, **k).limit(2).collect()]
    assert first("size") == [1, 2] and first("size", descending=True) == [14, 13] and first("name") == [1, 10] and first("hits", descending=True) == [2, 5] and first("type") == [2, 1]
    with pytest.raises(ValueError):
        rank.sorted_results(rows, "colour")


def test_fallback_and_keywords(s):
    assert [r["doc_id"] for r in s.fallback(["會議", "纪"]).collect()] == [] and sorted(r["doc_id"] for r in s.fallback(["budget", "committee"]).collect()) == [11]


def test_regex_budget(s, monkeypatch):
    monkeypatch.setattr(search_module, "REGEX_SECONDS", 0.0)
    with pytest.raises(QueryError) as e:
        s.page("(a+)+b", Options(regex=True))
    assert e.value.code == "regex_timeout"
