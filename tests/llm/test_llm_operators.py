"""The ten operators against brute-force versions, on small fixtures with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebars.llm import arrow_text, chat, graph, html_text, jaccard, licences, mixing, neighbours, packing, quality, substring, token_files
from tidebars.llm.queries import tokenizer_path
from tidebars.llm.store import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, cell long, spans string, list string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, shared passages, nulls, empties, a very long one; extra columns with busy names."""
    base, passage = words(1, 300), words(2, 40)
    out = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:290] + words(3, 10))), (3, None), (4, ""), (5, " \n\t "), (6, "only three words"), (7, "only three words"), (8, "Only Three  WORDS")]
    for i in range(20):
        w = words(10 + i, 120)
        out.append((20 + i, " ".join(w[:60] + passage + w[60:])))
    for i in range(30):
        rng = np.random.default_rng(100 + i)
        w = list(base)
        for j in rng.integers(0, 300, int(rng.integers(1, 12))):
            w[j] = f"x{i}y{j}"
        out.append((60 + i, " ".join(w)))
    out.append((200, " ".join(words(9, 30_000))))
    out += [(6, "only three words"), (None, " ".join(base)), (None, None), (21, "a second text under one id " + " ".join(passage))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "h", 1, 2, 3, "s", "l") for d, t in rows], SCHEMA).repartition(3).cache()


def shingles(text: str | None) -> frozenset:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_matches_brute_force(docs, rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), d)
    expected = Counter((d, len(s), None if d is None else least[find(i)]) for i, (d, s) in enumerate(sets))
    assert Counter(map(tuple, jaccard.join(docs).collect())) == expected


def test_tree_loses_no_pair_and_bounds_overlap():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(400) < p, rng.integers(1, 1 << 62, 400, dtype=np.uint64), base)) for p in np.linspace(0, 0.4, 60)]
    points, sizes = [jaccard.count_vector(s) for s in sets], np.array([len(s) for s in sets])
    n = len(sets)
    found = set(jaccard.tree_pairs(points, sizes, np.arange(n), np.zeros(n, int), 75))
    near = {frozenset((i, j)) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert near and near <= {frozenset(p) for p in found}


def test_dealt_tokens_meet():
    """Two sets at the threshold share a dealt shingle, a core one of the smaller."""
    rng = np.random.default_rng(1)
    ranks = rng.permutation(1 << jaccard.FREQUENCY_BITS).astype(np.uint64)
    for n in (1, 2, 3, 4, 7, 50, 333):
        for _ in range(20):
            a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
            extra = rng.integers(1, 1 << 62, n // 3, dtype=np.uint64)
            b = np.unique(np.concatenate([a, extra]))
            if 100 * len(a) < 75 * len(b):
                continue
            x, y = jaccard.dealt_tokens(a, ranks, 75), jaccard.dealt_tokens(b, ranks, 75)
            assert set((x[x & np.uint64(1) == 1] >> np.uint64(1)).tolist()) & set((y >> np.uint64(1)).tolist())


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 9), (9, 1), (7, 7), (50, 3)], "a long, b long")
    got = dict(graph.components(edges).collect())
    assert got == {i: 100 for i in range(101, 141)} | {2: 1, 9: 1, 50: 3}


def test_substring_matches_brute_force(docs, rows):
    windows: dict[tuple, int] = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        if d is not None:
            for i in range(len(w) - 12):
                g = tuple(w[i : i + 13])
                windows[g] = min(windows.get(g, d), d)
    expected = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {i + j for i in range(len(w) - 12) if d is not None and windows.get(tuple(w[i : i + 13]), d) < d for j in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert Counter(map(tuple, substring.report(docs).collect())) == Counter(expected)


def test_automaton_against_search():
    rng = np.random.default_rng(5)
    for _ in range(30):
        texts = [rng.integers(0, 3, rng.integers(1, 25)).tolist() for _ in range(4)]
        a = substring.SuffixAutomaton()
        for owner, t in enumerate(texts):
            a.add(t, owner)
        a.finish()
        query = rng.integers(0, 3, 30).tolist()
        for before in range(5):
            want = [i for i in range(3, 30) if any(texts[o][k : k + 4] == query[i - 3 : i + 1] for o in range(min(before, 4)) for k in range(len(texts[o])))]
            assert a.ends(query, 4, before) == want


def reference_ids(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for _, x in rows]


def test_packing_holds_every_id_once(docs, rows):
    got = packing.pack(docs, tokenizer_path(), 2, 512, with_ids=True).collect()
    ids = reference_ids(rows, 2)
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for (d, _), own in zip(rows, ids, strict=True):
        if sum(x == d for x, _ in rows) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(own) and r["ids"] == own[at : at + r["length"]].tobytes()
                at += r["length"]
            assert at == len(own)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_tokens"]))
    pad = 0
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512 and (parts[0][2] == 512 or parts[0][2] == at and at & (at - 1) == 0)
        pad += parts[0][2] - at
    assert pad <= 0.02 * sum(map(len, ids)) + 512


@pytest.mark.parametrize("lengths", [[3000] * 400, [3] * 4000, [2047] * 700, [4096, 8192, 1, 4097], list(range(1, 700)), [100_000, 5]], ids=["3000", "3", "2047", "whole", "rising", "long"])
def test_packer(lengths):
    packer = packing.Packer(4096, 32)
    sequences: list = []
    for i, n in enumerate(lengths):
        sequences += list(packer.add(i, np.arange(n, dtype="<u4")))
        assert len(packer.waiting) <= 32 and all(sum(len(p.ids) for p in own) <= 4096 for own in packer.open.values())
    sequences += list(packer.finish())
    seen: dict = {}
    for s in sequences:
        assert 0 < sum(len(p.ids) for p in s) <= 4096
        for p in s:
            assert p.ids[0] == p.start and p.doc_tokens == lengths[p.doc_id]
            seen.setdefault(p.doc_id, []).append((p.start, len(p.ids)))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[i]):
            assert start == at
            at += size
        assert at == n
    padding = 4096 * len(sequences) - sum(lengths)
    assert padding <= 4096 + len(sequences) * packer.sliver and sum(map(len, seen.values())) <= 1.8 * sum(-(-n // 4096) for n in lengths)


def test_packing_closes_bins_of_a_class():
    """Documents of one class stand together, as many as the class has, and none is cut."""
    packer = packing.Packer(4096)
    out = [s for i in range(12) for s in packer.add(i, np.zeros(1021, "<u4"))]
    assert out == [] and [[p.doc_id for p in s] for s in packer.waiting.values()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    packer = packing.Packer(4096)
    out = [s for i in range(12) for s in packer.add(i, np.zeros(1024, "<u4"))]
    assert [[p.doc_id for p in s] for s in out] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_token_files_round_trip(spark, docs, rows):
    path = new_path(spark, "test-files")
    token_files.write_token_files(docs, tokenizer_path(), 1, path, shard_ids=5_000)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    ids = reference_ids(rows, 1)
    expected = Counter((d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(rows, ids, strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [3, 3, 9, 1000, 1000], list(range(0, 5000, 7))])
def test_elias_fano(values):
    v = np.array(values, np.int64)
    data = token_files.EliasFano.encode(v, int(v[-1]) if len(v) else 0)
    e = token_files.EliasFano(data)
    assert e.all().tolist() == values and [e.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e.select(len(values))


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    from tidebars.llm.tokens import WordTokenizer

    texts = ["<|endoftext|> hi<|endoftext|>x", "‡ a ‡b", "\xa0x y \x1c z", "İstanbul ǅ é ́a ﬁ", "don't DON'T", "", "a" * 5000, "x.***$ 12 3a"]
    t = Tokenizer.from_file(tokenizer_path())
    column = pa.array(texts)
    data, at = arrow_text.buffers(column)
    ids, bounds = WordTokenizer(tokenizer_path()).encode(data, at)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_html():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy the thing of the day</div>"
        "<article><h1>Head &amp; line</h1><p>First  of the <b>article</b>\n text &lt;p&gt; that is long enough to be the text of it, with the words of the language.<p>Short.</p><aside>See also</aside></article>"
        "<div id=comments><p>I like the article and the words of it very much, it is the best of all that there is to read.</p></div><footer>&copy; us</footer></body></html>"
    )
    assert html_text.main_text(page) == "Head & line\nFirst of the article text <p> that is long enough to be the text of it, with the words of the language.\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == "" or html_text.main_text("<p") in ("", "<p")


def test_html_without_article_inherits_from_neighbours():
    long = "This is the text of a block that is long, with many of the words which are common in the language, and it goes on for a while so that it is decided."
    page = f"<div class=menu><a href=1>One</a> <a href=2>Two</a></div><p>{long}</p><p>Tiny.</p><p>{long}</p><ul><li><a href=1>Link</a></li><li><a href=2>Other</a></li></ul>"
    assert html_text.main_text(page) == f"{long}\nTiny.\n{long}"


@pytest.mark.parametrize("wrap", ["class='overflow-hidden'", "style='overflow:hidden'", "aria-hidden=false", "class='layout has-sidebar'", "class='post no-comments'", "class='single comments-open'", "class='entry share-enabled'", "class='layout-sidebar'", "class='widget'"])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_html_keeps_wrapped_text(wrap, tag):
    long = "This is the text of a block that is long, with many of the words which are common in the language, and it goes on for a while so that it is decided."
    page = f"<body><nav><a href=1>One</a></nav><div {wrap}><{tag}><p>{long}</p><p>{long}</p></{tag}></div><div class='site-footer'><p>{long}</p></div></body>"
    assert html_text.main_text(page) == f"{long}\n{long}"


@pytest.mark.parametrize("bad", ["hidden", "hidden=''", "aria-hidden='true'", "style='color:red; display: none'", "id=comments class='comments-area'", "class='related-posts'"])
def test_html_drops_hidden_and_named(bad):
    long = "This is the text of a block that is long, with many of the words which are common in the language, and it goes on for a while so that it is decided."
    page = f"<body><div><p>{long}</p><p>{long}</p></div><div {bad}><article><p>Not of it: {long}</p></article></div></body>"
    assert html_text.main_text(page) == f"{long}\n{long}"


def test_html_rows(spark):
    got = html_text.extract(spark.createDataFrame([(1, "u", None), (1, None, ""), (None, "u", "<article><p>a&nbsp;b</p></article>")], "page_id long, url string, html string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "u", "", 0), (1, None, "", 0), (None, "u", "a b", 3)])


def test_chat_round_trip(spark):
    hard = ["", "<|im_end|><|im_start|>assistant ok", "\\", "\\0\\1\\2", "<\\2|", "<|<|", "a\nb", "\\n<|", "é<|im_start|>"]
    turns = [(7, i, role, t) for i, (role, t) in enumerate((r, t) for t in hard for r in ("user", "assistant", "odd\nrole<|", None))] + [(None, None, "user", None), (8, 1, "assistant", "x"), (8, 1, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.coalesce("text", F.lit("")))).drop("text")
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in formatted.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got[7] == [(role or "", t) for _, _, role, t in turns[: 4 * len(hard)]]
    assert got[8] == [("assistant", "x")] * 2 and got[None] == [("user", "")]
    for r in formatted.collect():
        raw = r["formatted"].encode()
        own = [t for c, _, role, t in turns if c == r["conv_id"] and role == "assistant"]
        assert [raw[m["start"] : m["start"] + m["length"]].decode() for m in r["loss_mask"]] == [(t or "").replace("\\", "\\0").replace("<|", "<\\2|") for t in own]
    d = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    loss = "".join(t for _, _, role, t in turns[: 4 * len(hard)] if role == "assistant")
    assert d[7]["loss_chars"] == len(loss) and d[7]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_parts(spark):
    part = lambda kind, **k: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    rows = [(1, 0, "user", [part("text", text="see "), part("image", ref="i", width=57, height=28), part("audio", ref="a", seconds=0.1), part("document", ref="d", pages=2), part("text", text="<|")]), (1, 1, "assistant", None)]
    got = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert [(f["kind"], f["ref"], f["tokens"]) for f in got["attachments"]] == [("image", "i", 3), ("audio", "a", 3), ("document", "d", 512)] and got["expanded_tokens"] == 518
    assert got["formatted"].startswith("<|im_start|>user\nsee " + "<|image|>" * 3 + "<|audio|>" * 3 + "<|document|>")


def test_mixing_reaches_targets(spark):
    rng = np.random.default_rng(3)
    data = [(i, " ".join(["w"] * int(rng.integers(1, 60))), str(rng.choice(["en", "fr"], p=[0.8, 0.2])), str(rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1])), 1) for i in range(2000)] + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(df, targets={"source": {"a": 1.0, "b": 1.0, "c": 1.0}}, rounds=30, clip=0.01)
    share = {r["source"]: r["w"] for r in out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("w")).collect() if r["source"]}
    total = sum(share.values())
    assert all(abs(share[s] / total - 1 / 3) < 0.02 for s in "abc") and out.count() == 2002
    sampled = out.where("sampled").groupBy("source").agg(F.sum("tokens").alias("w")).collect()
    assert all(abs(r["w"] - share[r["source"]]) < 0.25 * share[r["source"]] for r in sampled if r["source"])
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_keeps_rare_categories(spark):
    rows = [(i, "x " * 200, "en", "big") for i in range(300)] + [(1000 + i, "x " * 200, "en", f"s{i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    own = {r["source"]: r["p"] for r in mixing.mix(df).groupBy("source").agg(F.sum("probability").alias("p")).collect()}
    # 300 sources of 2 documents and one of 300, to the power of ALPHA
    assert np.isclose(own["big"] / own["s7"], 150**mixing.ALPHA, rtol=1e-3)
    out = mixing.mix(df, targets={"source": {"big": 1.0, "s7": 1.0, "*": 0.0}})
    got = {r["source"]: r["p"] for r in out.groupBy("source").agg(F.sum("probability").alias("p")).collect()}
    assert np.isclose(got["big"], got["s7"], rtol=1e-3) and got["s7"] > 0 and got["s8"] == 0


def test_mixing_targets_of_rare_absent_and_unnamed_categories(spark):
    rows = [(i, "x " * 20, "en", "big") for i in range(400)] + [(1000, "x " * 20, "en", "tail"), (1001, "x " * 20, "en", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    p = lambda **o: {r["source"]: (r["probability"], r["marginal_error"]) for r in mixing.mix(df, **o).select("source", "probability", "marginal_error").distinct().collect()}
    got = p(targets={"source": {"big": 0.5, "tail": 0.5}})
    assert got["tail"][0] == 1.0 and np.isclose(got["big"][0], 1 / 400, rtol=1e-3) and got["other"][0] > 0 and got["big"][1] < 1e-9
    got = p(targets={"source": {"big": 0.5, "tail": 0.5}}, clip=0.01)
    assert got["tail"][0] == 1.0 and got["big"][0] == 1.0
    got = p(targets={"source": {"big": 0.5, "*": 0.5}})
    assert np.isclose(got["tail"][0] + got["other"][0], 2 * 1.0) and np.isclose(got["big"][0], 2 / 400, rtol=1e-3)
    with pytest.raises(ValueError, match="none, nowhere"):
        p(targets={"source": {"big": 0.5, "none": 0.2, "nowhere": 0.3}})
    got = p(targets={"source": {"big": 0.5, "tail": 0.4, "none": 0.1}}, strict=False)
    assert got["tail"][0] == 1.0


def test_mixing_uses_a_topic_column(spark):
    rows = [(i, "x " * 20, "en", "s", "a" if i % 4 else "b", 1.5, 7) for i in range(200)] + [(900, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, probability double, tokens int")
    out = mixing.mix(df, targets={"topic": {"a": 1.0, "b": 1.0}})
    got = {r["topic"]: r["p"] for r in out.groupBy("topic").agg(F.sum("probability").alias("p")).collect()}
    assert np.isclose(got["a"], got["b"], rtol=1e-6) and out.columns == ["doc_id", "text", "lang", "source", "tokens", "topic", "probability", "marginal_error", "sampled"]
    taken = mixing.sampled(df, targets={"topic": {"a": 1.0, "b": 1.0}})
    assert taken.schema == df.schema and {(r["tokens"], r["probability"]) for r in taken.where("doc_id < 900").collect()} == {(7, 1.5)}


def test_licences_match_brute_force(spark):
    texts = [None, "", "x the MIT License, and GNU general public license; Apache-license CC BY-NC 4.0", "mit mit license mit license", "gnu general public", "All rights reserved", licences.TEMPLATES[0][1].upper().replace(" COPY ", " fair copy "), "ümit license mit licenseé"]
    got = licences.scan(spark.createDataFrame([(i % 3, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row long")).collect()
    expected = []
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for p, label in licences.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        expected.append((i % 3, len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({b for _, b in at}))))
    assert Counter(tuple(r)[:6] for r in got) == Counter(expected)
    labels = {r["n_words"]: r["labels"] for r in got}
    assert labels[3] and "all-rights-reserved" in labels.values() and any("mit" == r["labels"] and r["n_base"] == 0 and r["score"] >= 0.8 for r in got)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def diagonal_votes(w: list[str]) -> tuple[set, float]:
    """Labels and best score of a text's words, by counting matches on every diagonal of every template."""
    labels, best = set(), 0.0
    tables = [(True, licences.PHRASE_K, label, words) for words, label in licences.PHRASES] + [(False, licences.TEMPLATE_K, label, words) for label, words in licences.TEMPLATES]
    for base, k, label, phrase in tables:
        template = phrase.split()
        lines: dict = {}
        for p in range(len(w) - k + 1):
            for q in range(len(template) - k + 1):
                if w[p : p + k] == template[q : q + k]:
                    lines.setdefault(p - q, set()).add(q)
        groups: list = []
        for d in sorted(lines):
            if groups and not base and d - groups[-1][0] <= licences.SLACK:
                groups[-1] = (d, groups[-1][1] | lines[d])
            else:
                groups.append((d, lines[d]))
        for _, starts in groups:
            score = len({q + j for q in starts for j in range(k)}) / len(template)
            if score >= (1.0 if base or len(template) < licences.LONG_TEMPLATE else licences.COVERAGE):
                labels.add(label)
                best = max(best, score)
    return labels, best


def test_licence_votes_match_brute_force(spark):
    rng = np.random.default_rng(21)
    texts: list = [None, ""]
    for label, passage in licences.TEMPLATES:
        for _ in range(4):
            w = passage.split()
            for _ in range(int(rng.integers(0, 1 + len(w) // 5))):
                at, what = int(rng.integers(0, len(w))), rng.integers(0, 3)
                w[at : at + (what != 1)] = [] if what == 0 else ["word"]
                w = w or ["x"]
            texts.append(" ".join([*words(int(rng.integers(0, 99)), 3), *w, "and so on"]))
    texts.append(" ".join(p for _, p in licences.TEMPLATES[:6]))
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hits = 0
    for i, t in enumerate(texts):
        labels, best = diagonal_votes(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
        hits += bool(labels)
        assert got[i]["labels"] == ",".join(sorted(labels)) and np.isclose(got[i]["score"], best), t
    assert len(texts) // 3 < hits < len(texts) - 10


def test_quality_measures(spark):
    text = "one two three four one two three\n\n one two three four one two three\nx#y $|\none two three four one two three"
    got = quality.report(spark.createDataFrame([(1, text, "h"), (1, text, "h"), (2, None, None), (None, " ".join(words(4, 80)), "h")], "doc_id long, text string, source string")).collect()
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    own = [r for r in got if r["doc_id"] == 1]
    assert len(own) == 2 and own[0] == own[1]
    r = own[0]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), 3, 1, len(covered)) and r["base_failed"] and not r["kept"]
    assert [(r["n_words"], r["kept"]) for r in got if r["doc_id"] in (2, None)] in ([(0, False), (80, True)], [(80, True), (0, False)])


def test_quality_rejects_depleted(spark):
    menu = [" ".join(words(50 + i, 9)) for i in range(8)]
    rows = [(i, "\n".join([*menu, " ".join(words(500 + i, 20))]), "host") for i in range(30)] + [(100 + i, menu[0] + "\n" + " ".join(words(900 + i, 90)), "host") for i in range(30)]
    kept = {r["doc_id"] for r in quality.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {100 + i for i in range(30)}


#: Names that operators use inside, or add.
BUSY = ("removed", "probability", "tokens", "topic_", "_tokens", "_source", "n_words", "kept_sha256", "spans", "_doc", "_h", "_spans", "h", "owner", "gone", "id", "row", "salt", "kept", "sampled", "w", "g_source", "a.b", "columns that ride along ")


@pytest.mark.parametrize("run", [quality.judge, quality.clean, substring.clean, substring.deduplicated, mixing.mix, mixing.sampled], ids=["judge", "quality", "measured", "substring", "mix", "sampled"])
def test_clashing_columns_ride_along(spark, rows, run):
    data = [(d, t, "en", "h", *[f"{i}/{n}" for n in BUSY]) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, {', '.join(f'`{n}` string' for n in BUSY)}")
    out = run(df)
    added = [c for c in out.columns if c not in df.columns]
    got = out.collect()
    own = [c for c in df.columns if out.schema[c].dataType == df.schema[c].dataType and (added or len(out.columns) == len(df.columns))]
    plain = run(df.select("doc_id", "text", "lang", "source"))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in plain.collect())
    measures = set(plain.columns)
    for r in got:
        values = {r[c].split("/")[0] for c in own if c in BUSY and c not in measures}
        assert len(values) == 1 and all(r[c].split("/")[1] == c for c in own if c in BUSY and c not in measures)


def test_quality_takes_lines_out(spark):
    rows = [(i, f"{' '.join(words(i, 60))}\nAll Rights  reserved here\n{' '.join(words(900 + i, 5))}", "h") for i in range(25)] + [(50, f"All rights reserved here\n{' '.join(words(50, 60))}", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(got[d]["text"] == t.replace("All Rights  reserved here\n", "") for d, t, _ in rows) and got[3]["removed"] == 4 and got[3]["clean_words"] == got[3]["n_words"] - 4 and got[50]["removed"] == 0


def test_neighbours_recall_and_edge_cases(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:760] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, [1.0]), (2500, [float("inf")] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hit += len({v for v, _ in found} & set(best.tolist()))
        assert len(found) == 10 and all(abs(d[v] - s) < 1e-9 for v, s in found) and found == sorted(found, key=lambda t: (t[1], t[0]))
    assert hit >= 0.95 * 10 * len(got)
    assert [v for v, _ in got[0]] == list(range(700, 710))
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert [(r["vec_id"], r["rank"]) for r in few.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_empty_pages_and_conversations(spark, docs):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    turns = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.digests(chat.format_conversations(turns)).count() == 0
    path = new_path(spark, "empty-files")
    token_files.write_token_files(docs.limit(0), tokenizer_path(), 1, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_token_files_refuse_ids_that_do_not_fit():
    with pytest.raises(ValueError, match="2 bytes"):
        token_files.pack_shard([1], [np.array([70_000], np.uint32)], 2)
    shard = token_files.Shard(token_files.pack_shard([1], [np.array([70_000], np.uint32)], 4))
    assert shard.document(0).tolist() == [70_000]


@pytest.mark.parametrize("run", [jaccard.join, substring.report, lambda d: packing.pack(d, tokenizer_path(), 2), licences.scan, quality.report, mixing.report], ids=["jaccard", "substring", "packing", "licences", "quality", "mixing"])
def test_empty_tables(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_neighbours_with_an_outlier_and_repeated_ids(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 24))
    x[5] *= 1e9
    ids = [*range(2990), *range(100, 110)]  # ten ids stand on two rows each
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>, node int, row string")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["rank"], r["score"]))
    want: dict = {}
    for q in [i for i, v in enumerate(ids) if v % 100 == 0]:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want.setdefault(ids[q], []).extend(ids[j] for j in np.lexsort((ids, d))[:10])
    hit = sum(len(list((Counter(v for v, _, _ in found[q]) & Counter(w)).elements())) for q, w in want.items())
    assert set(found) == set(want) and len(found[100]) == 20 and hit >= 0.95 * sum(map(len, want.values()))
