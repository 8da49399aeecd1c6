import math
import re
from collections import Counter, defaultdict

import pytest

from tarnfield.llm import fertility, queries

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    inside = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed)


PLAIN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_plain_rules_of_every_text(spark, docs, odd):
    for given in (docs, odd):
        for r in fertility.measured(given.select("doc_id", "text")).collect():
            assert tuple(r[c] for c in PLAIN) == plain(r["text"])


def test_measures_of_every_text(spark, docs):
    import base64

    import sentencepiece
    import tiktoken

    with open(f"{fertility.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    by_bytes = tiktoken.Encoding("t", pat_str=fertility.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{fertility.TOKENIZERS}/piece_bpe_32k.model")
    for r in fertility.measured(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        a = [t for w in words for t in by_bytes.encode_ordinary(" " + w)]
        b = [p for w in words for p in pieces.encode(w, out_type=str)]
        if not words:
            assert r["token_entropy"] is None
            continue
        size = min(64, len(a))
        starts = list(range(0, len(a) - size + 1, size))
        if len(a) % size:
            starts.append(len(a) - size)
        bits = [-sum(n / size * math.log2(n / size) for n in Counter(a[s : s + size]).values()) for s in starts]
        assert r["token_entropy"] == pytest.approx(sum(bits) / len(bits))
        assert r["chars_per_byte_token"] == pytest.approx(sum(map(len, words)) / len(a))
        assert r["chars_per_piece"] == pytest.approx(sum(map(len, words)) / len(b))
        assert r["byte_share"] == pytest.approx(sum(bool(re.fullmatch("<0x..>", p)) for p in b) / len(b))


def middle(values):
    return sorted(values)[(len(values) - 1) // 2]


def test_bands_and_verdicts_of_the_query(spark):
    """The whole query against bands counted plainly from its own measures."""
    rows = queries.op12_tokeniser_fertility(spark, FOLDER).collect()
    langs = {r["doc_id"]: r["lang"] for r in queries.read(spark, FOLDER, "documents").collect()}
    assert len(rows) == len(langs)
    good = [r for r in rows if not r["base_failed"]]
    per = Counter(langs[r["doc_id"]] for r in good)
    rare = Counter(r["script"] for r in good if per[langs[r["doc_id"]]] < fertility.ENOUGH)
    group = {}
    for r in rows:
        lang = langs[r["doc_id"]]
        if per[lang] >= fertility.ENOUGH:
            group[r["doc_id"]] = f"lang {lang}"
        else:
            group[r["doc_id"]] = f"script {r['script']}" if rare[r["script"]] >= fertility.ENOUGH else "all"
        assert r["group"] == group[r["doc_id"]]
    for r in rows:
        mates = [g for g in good if group[r["doc_id"]] in ("all", group[g["doc_id"]])]
        outside = []
        for m in fertility.MEASURES:
            per_unit = fertility.BINS[m]
            bins = [math.floor(g[m] * per_unit) for g in mates]
            mid = middle(bins)
            reach = fertility.WIDTH * max(middle([abs(b - mid) for b in bins]) / per_unit, fertility.LEAST[m])
            if r[m] is not None and abs(r[m] - (mid + 0.5) / per_unit) > reach:
                outside.append(m)
        assert r["outside"] == outside
        assert r["kept"] == (not r["base_failed"] and not outside)
    assert any(r["outside"] and not r["base_failed"] for r in rows)


def test_odd_rows_and_columns(spark, odd, none):
    out = fertility.judged(odd)
    added = [c for c in out.columns if c not in odd.columns]
    assert out.columns == [c for c in odd.columns if c not in ("group", "kept")] + added
    rows = out.collect()
    assert len(rows) == 12 and not any(r["kept"] for r in rows)
    assert sorted(str(r["text"]) for r in rows) == sorted(str(r["text"]) for r in odd.collect())
    assert all(r["_mark"] in ("own", None) for r in rows)
    assert fertility.judged(none).count() == 0
    clash = odd.selectExpr("doc_id", "text", "'own' AS of_lang", "'own' AS limits", "'own' AS kept", "'own' AS `group`")
    got = fertility.judged(clash).select("of_lang", "limits").distinct().collect()
    assert got == [("own", "own")]


def test_scripts(spark, monkeypatch):
    texts = ["Привет, мир abc", "漢字かな漢", "123 !!!", "hello", "αβγ Ω x", "a б"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert [r["script"] for r in fertility.measured(docs).collect()] == ["Cyrillic", "Han", "", "Latin", "Greek", "Latin"]


def test_forgetting_words_changes_nothing(docs):
    words = fertility.Words(fertility.TOKENIZERS)
    texts = [(r["text"] or "").encode().split() for r in docs.limit(40).collect()]
    words.learn(texts)
    want = [words.measures(fertility.np.array([words.number[w] for w in t], dtype=int)) for t in texts]
    for t, known in zip(texts, want):
        words.forget()
        words.learn([t])
        assert words.measures(fertility.np.array([words.number[w] for w in t], dtype=int)) == known
