import random

import pytest

from deskspark.operators import chunking as E
from deskspark.settings import Settings

PAGE = """intro line
# One
 first
second

third
## Two
text
```
# not a header

code
```
### Three
deep
#### Four
tail
## Five
~~~
``` inside
~~~
end
# One
last"""


def sections(spark, text):
    df = spark.createDataFrame([("d", text)], "source string, text string")
    rows = E.markdown_sections(df).orderBy("section").collect()
    return [(r.header_1, r.header_2, r.header_3, r.content) for r in rows]


def test_page(spark):
    assert sections(spark, PAGE) == [
        (None, None, None, "intro line"),
        ("One", None, None, "first\nsecond  \nthird"),
        ("One", "Two", None, "text\n```\n# not a header\n\ncode\n```"),
        ("One", "Two", "Three", "deep\n#### Four\ntail"),
        ("One", "Five", None, "~~~\n``` inside\n~~~\nend"),
        ("One", None, None, "last"),
    ]


def test_edges(spark):
    assert sections(spark, "# A\n\n# A\nx\n# A\ny") == [("A", None, None, "x  \ny")]
    assert sections(spark, "#nohead\n```\n# open fence") == [(None, None, None, "#nohead\n```\n# open fence")]
    assert sections(spark, "##\nx") == [(None, "", None, "x")]
    assert sections(spark, "# only") == []


@pytest.mark.parametrize("seed", range(6))
def test_split_invariants(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 12))) for _ in range(400)]
    text = "".join(w + rnd.choice([" ", " ", " ", "\n", "\n\n"]) for w in words)
    if seed == 5:
        text = "".join(rnd.choices("abcdefgh", k=2500))
    size, overlap = 200, 40
    pieces = E._pieces(text, size, overlap, ("\n\n", "\n", " ", ""))
    assert all(0 < len(p) <= size for p in pieces)
    spot = 0
    for p in pieces:                       # whole text is covered, in order
        at = text.find(p, max(0, spot - size))
        assert at >= 0 and text[spot:at].strip() == ""
        spot = max(spot, at + len(p))
    assert text[spot:].strip() == ""
    if seed == 5:                          # no separator: neighbours share exactly the overlap
        assert [len(p) for p in pieces[:-1]] == [200] * (len(pieces) - 1)
        assert len("".join(pieces)) == 2500 + 40 * (len(pieces) - 1)


def test_long_sections_are_split(spark):
    text = "# H\n" + " ".join(["word"] * 500) + "\n# S\nshort error"
    df = spark.createDataFrame([("/x/guide.md", text)], "source string, text string")
    rows = E.build_chunks(df, Settings(chunk_size=300, chunk_overlap=50)).orderBy("chunk_id").collect()
    assert len(rows) > 8 and all(len(r.content) <= 300 for r in rows)
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert [(r.header_1, r.category, r.priority) for r in rows if r.content == "short error"] == [("S", "technical", "high")]


def test_categories(spark):
    df = spark.createDataFrame([
        ("a plan to fix", "x"), ("it failed", "x"), ("the API", "x"), ("Create it", "x"), ("zzz", "/a/Pricing_list.md"),
        ("zzz", "b/errors.v2.md"), ("zzz", "getting.md"), ("zzz", ""), ("zzz", "/billing/readme.md"),
    ], "content string, source string")
    from pyspark.sql import functions as F
    got = [r[0]["category"] for r in df.select(E.chunk_category(F.col("content"), F.col("source"))).collect()]
    assert got == ["billing", "technical", "integration", "onboarding", "billing", "technical", "onboarding", "general", "general"]
    docs = spark.createDataFrame([("#### Problem: x",), ("How to x",), ("the request",), ("FAQ",), ("zzz",)], "content string")
    got = [r[0] for r in docs.select(E.doc_type(F.col("content"))).collect()]
    assert got == ["troubleshooting", "guide", "api_reference", "faq", "documentation"]


def test_python_sees_small_parts_of_a_batch():
    """However many texts come in one batch, a splitter's pieces are held for a part of them alone."""
    import pyarrow as pa

    from deskspark.functions import batches

    texts = [None, "", "x" * (3 << 20), *["y" * 5000] * 1000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    got = list(batches.parts(iter([batch.slice(1), batch.slice(0, 0)]), -1))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(1, len(texts)))
    assert all(b.num_rows == 1 or sum(len(t) for t in b.column(1).to_pylist()) <= batches.PART_BYTES for b in got)
    assert len(got) > 5
