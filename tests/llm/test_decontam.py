import random

from tarnfield.llm import decontam


def distance(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    last = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1))
        last = row
    return min(last)


def edited(text, edits, rng):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcdef")
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, rng.choice("abcdef"))
    return "".join(text)


def test_leaks_match_plain_alignment():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(40)) for _ in range(4)] + ["short text of it"]
    index = decontam.Index([(i, t.encode()) for i, t in enumerate(items)])
    docs = []
    for k in range(60):
        around = [" ".join(word() for _ in range(20)) for _ in range(2)]
        item = rng.choice(items)
        start = rng.randrange(max(1, len(item) - 90))
        docs.append(around[0] + " " + edited(item[start : start + 90 + k], k % 16, rng) + " " + around[1])
    found = index.leaks([d.encode() for d in docs])
    some = 0
    for doc, leaks in zip(docs, found):
        want = {
            index.item[w]
            for w, points in enumerate(index.points)
            if distance([chr(p) for p in points], " ".join(doc.lower().split())) <= index.edits[w]
        }
        assert {x["item_id"] for x in leaks} == want
        some += bool(want)
    assert 20 < some < 60


def test_documents_that_hold_an_item(spark, docs):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plain = lambda t: " ".join((t or "").lower().split())
    items = [plain(r["text"]) for r in benchmark.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(i in plain(r["text"]) for i in items)}
    kept = {r["doc_id"] for r in decontam.without_leaks(docs, benchmark).collect()}
    assert want and kept == {r["doc_id"] for r in docs.collect()} - want


def test_blocks_give_the_same(spark, docs, monkeypatch):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    key = lambda df: sorted((r["doc_id"], sorted(map(tuple, r["leaks"]))) for r in df.collect())
    whole = key(decontam.with_leaks(docs, benchmark))
    monkeypatch.setattr(decontam, "BLOCK", 3000)
    monkeypatch.setattr(decontam, "PIECE", 500)
    assert key(decontam.with_leaks(docs, benchmark)) == whole


def test_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame(
        [(1, "One  TWO three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, "x"), (None, "other words word " * 9)],
        "item_id long, text string",
    )
    found = decontam.with_leaks(odd, benchmark)
    hit = sorted(str((r["doc_id"], {x["item_id"] for x in r["leaks"]})) for r in found.collect() if r["leaks"])
    assert hit == sorted(["(1, {1})", "(1, {1})", "(None, {1})", "(5, {None})"])
    assert decontam.without_leaks(odd, benchmark).columns == odd.columns
    assert decontam.without_leaks(odd, benchmark.limit(0)).count() == 12
    assert decontam.with_leaks(none, benchmark).count() == 0


def test_passages_are_found_wherever_they_start():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))
    for size in (254, 161, 97):
        item = " ".join(word() for _ in range(80))[:size].rstrip().ljust(size, "x")
        index = decontam.Index([(3, b"another item that is short"), (7, item.encode())])
        around = " ".join(word() for _ in range(30))
        parts = [item[at : at + 80] for at in range(size - 79)]
        docs = [f"{around} {p} {around}" for p in parts + [edited(p, 3, rng) for p in parts]]
        found = index.leaks([d.encode() for d in docs])
        assert all([x["item_id"] for x in leaks] == [7] for leaks in found)
        assert index.leaks([around.encode()]) == [[]]


def test_passages_across_pieces(monkeypatch):
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(30))
    index = decontam.Index([(1, item.encode())])
    doc = "y" * 300 + item + "y" * 300
    whole = index.leaks([doc.encode()])
    monkeypatch.setattr(decontam, "PIECE", 64)
    assert index.leaks([doc.encode()]) == whole and whole[0]
