from tarnfield.llm import linededup


def plain(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_later_windows_go(spark):
    rows = [
        (3, "p\nq\nr\ns\nend"), (1, "x\nq\nr\ns\nt"), (2, "a\na\na\na\na"), (5, "a\na\nother"), (None, "q\nr\ns\nt"), (7, "q\nr\ns\n"),
    ]
    found = linededup.without_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == plain(rows)


def test_odd_rows(odd, none):
    found = linededup.without_repeated_windows(odd)
    rows = found.collect()
    assert len(rows) == 12 and found.columns[:10] == [c for c in odd.columns if c != "text"]
    texts = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in rows}
    assert texts[2] == (None, 0, 0) and texts[3] == ("", 1, 0)
    assert texts[6] == ("a\nb\nc\nd\nx", 8, 3)
    assert texts[8] == ("", 3, 3)
    assert linededup.without_repeated_windows(none).count() == 0
