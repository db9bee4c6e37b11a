import io
import re
import unicodedata
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.functions import embedding, text
from quarry.operators.chunk import chunk_lines
from quarry.sources import convert
from quarry.sources.catalog import Catalog, input_error, read_texts
from quarry.streaming.ingest import watch


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("notes/may.md:3-9", ("notes/may.md", 3, 9)),
        ("a b/c/d.rst:71-1204", ("a b/c/d.rst", 71, 1204)),
        ("big.log:500000-700000", ("big.log", 500000, 700000)),
        ("a:b:3-4", ("a:b", 3, 4)),
        ("no place", ("no place", 0, 0)),
        ("plan.md:12", ("plan.md:12", 0, 0)),
        ("plan.md:x-y", ("plan.md:x-y", 0, 0)),
    ],
)
def test_parse_location(spark, value, expected):
    assert tuple(one(spark, text.parse_location, value)) == expected


def test_tokens_count_unicode_space(spark):
    assert one(spark, text.estimate_tokens, " a b  c\n") == 10
    assert one(spark, text.estimate_tokens, "") == 0


def normal(said):
    """The steps of the cleaning, in order, on one text."""
    out = re.sub("[֑-ׇ׳״]", "", said)
    out = "".join(c for c in out if c not in "­​‌‍﻿")
    out = "".join(c for c in out if c in "\n\t" or not unicodedata.category(c).startswith("C"))
    while "  " in out:
        out = out.replace("  ", " ")
    out = "\n".join(line.rstrip() for line in out.split("\n"))
    while "\n\n\n" in out:
        out = out.replace("\n\n\n", "\n\n")
    out = re.sub(" +(?=[.,;:!?])", "", out)
    out = re.sub("(?m)^\\s*[•·∙●○◦▪▫■□▬▭▮▯◆◇◈◊]\\s+", "- ", out)
    return unicodedata.normalize("NFC", out).strip()


def test_normalize(spark):
    raw = "﻿é­  x , y​  \n\n\n\n• item\u0007\n"
    texts = [raw, None, "", "  　 ", "a\tb \t\nc  \n\n \n\nd", "שׁלום ׳x", "é ‪‎x y", "a\r\nb", "   , x  !  ?"]
    texts += [f"x\n\n {b}  item\n{b}no\n{b}\n\n{b} y" for b in text.BULLETS]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.normalize_text(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in found} == {i: None if t is None else normal(t) for i, t in enumerate(texts)}
    assert normal(raw) == "é x, y\n- item" and len(text.BULLETS) == 18


def test_language(spark):
    assert one(spark, text.detect_languages, "א" * 10 + "a" * 90) == ("english", ["english"])  # a tenth is not over a tenth
    assert one(spark, text.detect_languages, "אב a") == ("hebrew", ["hebrew", "english"])
    assert one(spark, text.detect_languages, "123") == ("unknown", ["unknown"])
    assert one(spark, text.safe_file_name, "/a/b c?.tar.pdf") == "b c.tar.md"


def test_chunk_rules():
    assert chunk_lines("a b\n" * 2, 100) == [("a b\na b\n", 1, 3)]
    line = " ".join(["w"] * 36)
    assert chunk_lines(line, 128) == [(line, 1, 1)]
    pieces = chunk_lines("x\n" + " ".join(["w"] * 100) + "\ny", 128)
    assert [(len(c.split()), a, b) for c, a, b in pieces] == [(1, 1, 1), (42, 2, 2), (42, 2, 2), (16, 2, 2), (1, 3, 3)]
    assert chunk_lines("\n \n", 10) == [] and chunk_lines("", 10) == []
    assert [c[1:] for c in chunk_lines("\n".join(["a b c d"] * 5), 28)] == [(1, 2), (3, 4), (5, 5)]


def docx(*body):
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {names}><w:body>{''.join(body)}</w:body></w:document>")
    return out.getvalue()


def para(said, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{said}</w:t></w:r></w:p>'


def test_docx_keeps_order_after_a_table(spark):
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr>"
    data = docx(para("Top", "Heading1"), para("Hello"), f"<w:tbl>{row('a', 'b')}{row('1', '2')}</w:tbl>", para("Sub", "HeadingX"), para("End"))
    files = spark.createDataFrame([("/x/Doc.DOCX", data), ("/x/bad.docx", b"no"), ("/x/y.odt", b"")], "path string, content binary")
    done = {r["path"]: r for r in convert.convert(files).collect()}
    assert done["/x/Doc.DOCX"]["text"] == "# Top\n\nHello\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n## Sub\n\nEnd"
    assert done["/x/Doc.DOCX"]["markdown"].startswith("---\nsource: Doc.DOCX\npages: 2\nlanguage: english\n")
    assert "BadZipFile" in done["/x/bad.docx"]["error"] and "unsupported" in done["/x/y.odt"]["error"]
    stats = convert.conversion_stats(convert.convert(files)).first()
    assert (stats["converted"], stats["failed"], stats["skipped"], stats["pages"]) == (1, 1, 1, 2)
    assert stats["seconds"] > 0 and stats["seconds_per_page"] == pytest.approx(stats["seconds"] / 2)
    none = convert.conversion_stats(convert.convert(files.where("path = '/x/y.odt'"))).first()
    assert (none["converted"], none["skipped"], none["seconds"], none["seconds_per_file"]) == (0, 1, 0, None)


def test_options_go_to_the_converters_that_know_them(spark, monkeypatch):
    monkeypatch.setitem(convert.CONVERTERS, ".scan", lambda data, dpi=300: (f"at {dpi}", 1))
    files = spark.createDataFrame([("/x/a.scan", b""), ("/x/b.txt", b"plain"), ("/x/c.txt", b" ")], "path string, content binary")
    done = {r["path"]: (r["text"], r["error"]) for r in convert.convert(files, dpi=72, language="eng").collect()}
    assert done == {"/x/a.scan": ("at 72", None), "/x/b.txt": ("plain", None), "/x/c.txt": (None, "ValueError: no text found")}


def test_page_text(spark):
    html = "<html><style>x</style><script>var t='</p>';</script><p>A &amp; b<br>c</p><!-- no --><div>d</div></html>"
    assert one(spark, convert.page_text, html) == "A & b\nc\nd"


def test_inputs_refused(spark, tmp_path):
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("x")
    for bad, why in (("https://x/y", "address"), ("git@host:x", "address"), ("repo.git", "repository"), (str(tmp_path), "directory"), (str(tmp_path / "repo"), "repository"), (str(tmp_path / "none"), "not found")):
        assert why in input_error(spark, bad)
        with pytest.raises(ValueError, match=why):
            read_texts(spark, [bad])
    assert input_error(spark, str(tmp_path / "a.txt")) is None and input_error(spark, str(tmp_path / "*.txt")) is None


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "auth.txt").write_text("login tokens and sessions\n\nlogin needs a password\n" + "filler words here\n" * 40)
    (tmp_path / "in" / "food.txt").write_text("bread and butter\ncheese\n")
    out = Engine(spark, str(tmp_path / "root"))
    out.index([str(tmp_path / "in" / "auth.txt"), str(tmp_path / "in" / "food.txt")], size=20)
    return out


def test_index_search_extract(engine, tmp_path, spark):
    assert [r["corpus"] for r in engine.catalog.listing().collect()] == ["auth", "food"]
    assert engine.catalog.info("food").first()["chunk_count"] == 1
    found = engine.search("login password", top_k=3, min_score=0.1)
    assert found["sources"][0]["corpus"] == "auth" and found["quality_results"] >= 2 and "login" in found["answer"]
    assert "No results" not in found["answer"]
    assert engine.search("zebra", top_k=1, min_score=0.99)["answer"].startswith("Only 0")
    assert engine.sql("SELECT * FROM search('bread') EXCEPT SELECT * FROM search('login') WHERE min_score >= 0.1").count() == 1
    summary = engine.extract("login password", str(tmp_path / "report"), read_texts(spark, [str(tmp_path / "in" / "auth.txt")]), min_score=0.3).first()
    said = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect())
    assert summary["total_chunks"] >= 1 and "login needs a password" in said and "End of extraction" in said
    assert engine.extract("zebra", str(tmp_path / "none"), min_score=0.99).first()["total_chunks"] == 0
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError, match="characters"):
        engine.vector("w " * 74)
    assert len(engine.vector("w " * 73)) == 64


def test_incremental_delete_and_compatibility(engine, tmp_path, spark):
    files = str(tmp_path / "in" / "*.txt")
    assert engine.index([files], size=20).count() == 0
    (tmp_path / "in" / "food.txt").write_text("soup and a longer text\n")
    assert [r["corpus"] for r in engine.index([files], size=20).collect()] == ["food"]
    assert engine.catalog.compatible(["auth", "food"])["embedding_dim"] == 64
    engine.catalog.delete("food")
    assert [r["corpus"] for r in engine.catalog.listing().collect()] == ["auth"]
    assert engine.catalog.chunks().select("corpus").distinct().count() == 1
    with pytest.raises(FileNotFoundError):
        engine.catalog.delete("food")
    with pytest.raises(ValueError):
        engine.catalog.compatible(["auth", "food"])


def chunks_of(engine):
    return sorted((r["corpus"], r["source"], r["chunk"]) for r in engine.catalog.chunks().collect())


def test_named_corpora_of_several_files(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(f"words of {folder}\n")
    a, b = (str(tmp_path / f / "x.txt") for f in "ab")
    engine = Engine(spark, str(tmp_path / "root"))
    engine.index([a])
    engine.index([b])  # of the same stem
    path = f"file:{b}"
    assert chunks_of(engine) == [("x", path, "words of b\n"), ("x", "x.txt", "words of a\n")]
    engine.index({"one": [a, b], "two words": a})
    assert [r["corpus"] for r in engine.catalog.listing().collect()] == ["one", "two words", "x"]
    (tmp_path / "b" / "x.txt").write_text("other words\n")
    assert engine.index({"one": [a, b]}).count() == 1
    assert [c for c in chunks_of(engine) if c[0] == "one"] == [("one", path, "other words\n"), ("one", "x.txt", "words of a\n")]
    info = engine.catalog.info("one").first()
    assert (info["files"], info["chunk_count"], info["file_size"]) == (2, 2, 23)
    engine.catalog.delete("two words")
    assert [r["corpus"] for r in engine.catalog.listing().collect()] == ["one", "x"]


def test_files_that_become_blank_or_are_no_text(spark, tmp_path):
    engine, path = Engine(spark, str(tmp_path / "root")), tmp_path / "f.txt"
    (tmp_path / "g.txt").write_text("stays\n")
    for said, left in (("old words\n", ["old words\n"]), (" \n", []), ("back\n", ["back\n"]), ("", [])):
        path.write_text(said)
        assert [r["chunk_count"] for r in engine.index({"c": [str(path), str(tmp_path / "g.txt")]}).where("source = 'f.txt'").collect()] == [len(left)]
        assert [c[2] for c in chunks_of(engine)] == sorted([*left, "stays\n"])
    path.write_bytes(b"\xff\xfe bad")
    got = engine.index_each({"c": str(path), "d": str(tmp_path / "none.txt"), "e": str(tmp_path / "g.txt")}).collect()
    assert {(r["corpus"], r["chunk_count"], bool(r["error"])) for r in got} == {("c", 0, True), ("d", 0, True), ("e", 1, False)}


def test_a_search_reads_its_corpora_alone(engine, spark, tmp_path):
    plan = engine.rows("bread", ["food"], 0.1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*corpus[^\]]*food", plan)

    class Long(embedding.HashedWords):
        context_length = 1000

    assert Catalog(spark, str(tmp_path), Long()).context_length == 1000 and engine.catalog.context_length == 256


def test_search_as_a_table_function(engine, spark):
    engine.register_search("find")
    rows = spark.sql("SELECT corpus, max(score) AS best FROM find('bread butter') WHERE score > 0.1 GROUP BY corpus ORDER BY best DESC").collect()
    assert [r["corpus"] for r in rows] == ["food"] and rows[0]["best"] == pytest.approx(engine.rows("bread butter", min_score=0.1).first()["score"], abs=1e-6)
    assert spark.sql("SELECT * FROM find('login') a JOIN find('password') b USING (location) WHERE a.score > 0 AND b.score > 0").count() >= 1


def test_texts_over_an_embedders_context_are_cut():
    class Short:
        model, dim = "short", 1

        def embed(self, texts):
            if any(len(t) > 50 for t in texts):
                raise embedding.TooLong
            return np.array([[float(len(t))] for t in texts])

    assert embedding.embed_within("x" * 100, Short()).tolist() == [49.0] and embedding.embed_within("x" * 60, Short()).tolist() == [42.0]
    assert embedding.embed_all(["x" * 100, "y"], Short()).tolist() == [[1.0], [1.0]]
    with pytest.raises(embedding.TooLong):
        embedding.embed_within("x" * 1000, Short())


def test_streaming_ingest(engine, tmp_path, spark):
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "later.txt").write_text("fresh words\n")
    watch(spark, str(tmp_path / "new"), engine.catalog, str(tmp_path / "state"), once=True).awaitTermination(120)
    assert engine.catalog.info("later").first()["chunk_count"] == 1


def test_indexing_reads_this_run_alone(spark, tmp_path):
    """One more file: nothing of the chunk table is read, and contents are read once."""
    import json

    from quarry.sources import catalog

    for i in range(4):
        (tmp_path / f"f{i}.txt").write_text(f"file {i}\n" * 30)
    store = catalog.Catalog(spark, str(tmp_path / "root"))
    assert store.index(catalog.read_texts(spark, [str(tmp_path / f"f{i}.txt") for i in range(3)])).count() == 3
    read = []
    original = store._read
    store._read = lambda name, schema: (read.append(name), original(name, schema))[1]
    rows = store.index(catalog.read_texts(spark, [str(tmp_path / "f3.txt")])).collect()
    assert "chunks" not in read and [r["chunk_count"] for r in rows] == [store.chunks().where("corpus = 'f3'").count()] and rows[0]["chunk_count"] > 0
    assert store.corpora().count() == 4 and not list((tmp_path / "root" / "staged").iterdir())
    assert json.dumps(sorted(r["corpus"] for r in store.listing().collect())) == '["f0", "f1", "f2", "f3"]'


def test_a_prompt_is_bounded(engine, spark):
    rows = spark.range(1000).selectExpr("'c' corpus", "id chunk_index", "id / 1000 score", "'x:1-2' location", "concat('t', id) chunk")
    seen = []
    engine.generator = lambda prompt: seen.append(prompt) or "done"
    assert engine.answer("q", rows, most=7) == "done"
    assert seen[0].count("Source ") == 7 and "t999" in seen[0] and "t992" not in seen[0]


def test_large_files_are_indexed_by_ranges(spark, tmp_path):
    """The same chunks and catalog rows as by whole files; what is unchanged is skipped."""
    from quarry.sources import catalog

    paths = [str(tmp_path / f"f{i}.txt") for i in range(3)]
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text("\n".join(f"line {j} of file {i} " + "word " * (j % 50) for j in range(200)) + "\n" * i)
    (tmp_path / "blank.txt").write_text("\n \n")
    paths.append(str(tmp_path / "blank.txt"))
    whole, ranges = (catalog.Catalog(spark, str(tmp_path / r)) for r in ("whole", "ranges"))
    whole.index(catalog.read_texts(spark, paths), 60)
    assert ranges.index_large(paths, 60).count() == 4
    rows = lambda c: sorted(map(str, c.chunks().drop("embedding").collect()))
    assert rows(whole) == rows(ranges) and len(rows(whole)) > 100
    counts = lambda c: sorted((r["corpus"], r["chunk_count"], r["error"], r["file_size"]) for r in c.corpora().collect())
    assert counts(whole) == counts(ranges)
    assert ranges.index_large(paths, 60).count() == 0
    with pytest.raises(ValueError, match="not found"):
        ranges.index_large([str(tmp_path / "none.txt")])


def test_letters_are_counted_in_one_pass(spark):
    texts = ["abc", "", None, "שלום Abc é ӿ֐ֿ׀׿؀ \U0001f600[`{@", "×Zz", "א"] * 2
    for some in (pa.array(texts), pa.array(texts)[4:9], pa.array(texts)[2:3], pa.array([], pa.string())):
        want = [None if x is None else {"hebrew": sum("֐" <= c <= "׿" for c in x), "english": sum(c.isascii() and c.isalpha() for c in x)} for x in some.to_pylist()]
        assert text._letter_counts(some).to_pylist() == want
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    found = text.detect_languages(F.col("text"))
    for df in (rows.select(found["language"], found["detected"]), rows.groupBy(text.ocr_language(found["detected"])).count()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "regexp_replace" not in plan
        assert plan.count("ArrowEvalPython") == 1 and "pythonUDF1" not in plan
        df.collect()


def test_letters_of_a_very_long_text_are_compared_in_longs(spark, monkeypatch):
    assert {f.type for f in text._letter_counts(pa.array(["a"])).type} == {pa.int64()}
    many = [800_000_000, 215_000_000]  # Hebrew and Latin, in 1.8 GB
    monkeypatch.setattr(text, "_letter_counts", lambda texts: pa.StructArray.from_arrays([pa.array([n] * len(texts)) for n in many], names=["hebrew", "english"]))
    assert one(spark, text.detect_languages, "a") == ("hebrew", ["hebrew", "english"])
    assert one(spark, lambda x: text.ocr_language(text.detect_languages(x)["detected"]), "a") == "heb+eng"
