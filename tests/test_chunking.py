from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.schemas import DOCUMENT, parsed


def windows(spark, text, **sizes):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return [r.text for r in chunking.windows(df, "id", "text", **sizes).orderBy("window").collect()]


def reference_windows(sentences, max_chars=2800, overlap=320):
    """The rule of the windows, step by step."""
    out, start, i = [], 0, 0
    while i < len(sentences):
        size = sum(map(len, sentences[start:i]))
        if size + len(sentences[i]) <= max_chars:
            i += 1
            continue
        if start == i:
            out.append((i, i + 1))
            i = start = i + 1
            continue
        out.append((start, i))
        kept, j = 0, i
        while j > start and kept + len(sentences[j - 1]) <= overlap:
            j -= 1
            kept += len(sentences[j])
        start = j if kept + len(sentences[i]) <= max_chars else i
    if start < i:
        out.append((start, i))
    return [" ".join(sentences[a:b]) for a, b in out]


def sentence(n, letter="A"):
    return letter + "x" * (n - 2) + "."


def test_short_text_is_one_window(spark):
    assert windows(spark, "  One. Two.  ") == ["One. Two."]
    assert windows(spark, " \n ") == []


def test_windows_follow_the_rule(spark):
    cases = [[40] * 200, [2795, 100, 2795], [300, 2795], [10, 300, 2600, 100, 400, 321, 2700], [3000], [5, 3000, 5], [100] * 28 + [2800] + [320, 2480, 2481]]
    for sizes in cases:
        parts = [sentence(max(3, n), chr(65 + i % 26)) for i, n in enumerate(sizes)]
        text = " ".join(parts)
        expected = [text] if len(text) <= 2800 else reference_windows(parts)
        assert windows(spark, text) == expected, sizes


def test_long_sentence_after_short_one_makes_progress(spark):
    short, long = sentence(100), sentence(2795, "B")
    assert windows(spark, f"{short} {long}") == [short, long]


def document(**parts):
    return {"document_id": "abc4567890", "filename": "f.pdf", **parts}


def chunk(spark, doc):
    rows = spark.createDataFrame([{f.name: doc.get(f.name) for f in parsed(DOCUMENT).fields}], parsed(DOCUMENT))
    return chunking.chunk_documents(rows).orderBy("chunk_index").collect()


def test_document_structure(spark):
    section = lambda page, heading, text: {"page": page, "heading": heading, "text": text, "level": 1}
    rows = chunk(spark, document(
        title="Attention",
        sections=[section(1, "Abstract", "We propose."), section(2, "Introduction", "Models."), section(5, "Conclusion", "Done."), section(6, "Empty", " ")],
        tables=[{"page": 3, "table_number": 1, "headers": ["Model", "BLEU"], "rows": [["a", "1"]] * 25, "raw_text": ""}],
        images=[{"page": 4, "image_number": 2, "image_path": "p.png", "width": 1, "height": 1, "bounding_box": None}]))
    assert [r.chunk_type for r in rows] == ["title", "heading", "abstract", "heading", "introduction", "heading", "conclusion", "table", "figure_caption"]
    assert [r.chunk_index for r in rows] == list(range(9))
    assert rows[0].chunk_id == "chunk_00001_abc45678"
    assert rows[7].text.count("\n") == 20 and rows[7].text.startswith("Headers: Model | BLEU\na | 1")
    assert rows[8].multimodal_ref == "p.png" and rows[8].text == "Figure 2 on page 4. Source: p.png"


def test_bare_documents(spark):
    assert [r.chunk_type for r in chunk(spark, document(title="Only"))] == ["title"]
    assert chunk(spark, document(title="")) == []


def test_missing_id_raises(spark):
    import pytest

    with pytest.raises(Exception, match="missing required fields"):
        chunk(spark, {"title": "x", "document_id": None})


def test_window_plan_has_no_shuffle(spark, sf_dir):
    plan = chunking.windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and F is not None
