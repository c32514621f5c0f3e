"""The pipeline's stages against a brute-force version on a small corpus."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from tidebars.llm import mixing, quality
from tidebars.llm.queries import MIX_CLIP, MIX_TARGETS
from tidebars.llm.store import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    passage = words(2, 60)
    rows = [(i, " ".join(words(1000 + i, 150)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i % 3][1], "en", "s0") for i in range(9)]
    rows += [(200 + i, " ".join(words(3000 + i, 70) + passage + words(4000 + i, 70)), "fr", "s1") for i in range(10)]
    near = words(77, 200)
    rows += [(300 + i, " ".join([*near[:195], *words(5000 + i, 5)]), "en", "s2") for i in range(6)]
    rows += [(400, "too short", "en", "s0"), (401, None, "en", "s0"), (402, "", None, None)]
    path = tmp_path_factory.mktemp("corpus")
    df = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(2).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def expected(rows):
    """Rows after the stages before packing, by plain loops."""
    kept = [r for r in rows if len(WORD.findall(r[1] or "")) >= quality.MIN_WORDS]
    sets = []
    for _, t, _, _ in kept:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    least = {g: min(kept[i][0] for i in range(len(kept)) if group[i] == g) for g in set(group)}
    kept = [r for i, r in enumerate(kept) if r[0] == least[group[i]]]
    first: dict = {}
    for d, t, _, _ in kept:
        w = WORD.findall(t)
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), d), d)
    out = []
    for d, t, lang, s in kept:
        w = WORD.findall(t)
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(13)}
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), lang, s))
    return out


def mixture(rows):
    """doc_ids that the mixing stage takes, by plain loops over cells."""
    tokens = [max(1, len(WORD.findall(t))) for _, t, _, _ in rows]
    kind = lambda t, n: "licence" if "licens" in t.replace("L", "l") else "note" if n < 150 else "article" if n < 1500 else "book"
    keys = [(s or "", lang or "", kind(t, n)) for (_, t, lang, s), n in zip(rows, tokens, strict=True)]
    own: dict = {}
    for k, n in zip(keys, tokens, strict=True):
        own[k] = own.get(k, 0) + n
    total = sum(own.values())
    targets = []
    for d, name in enumerate(mixing.DIMENSIONS):
        share: dict = {}
        for k, n in own.items():
            share[k[d]] = share.get(k[d], 0) + n
        given = MIX_TARGETS.get(name)
        power = {c: n**mixing.ALPHA for c, n in share.items()}
        if given:
            free = sum(n for c, n in share.items() if c not in given) / total
            rest = sum(given[c] for c in share if c in given) * free / (1 - free) if free < 1 else 1.0
            unnamed = sum(v for c, v in power.items() if c not in given)
            power = {c: given[c] if c in given else rest * v / unnamed for c, v in power.items()}
        targets.append({c: v / sum(power.values()) for c, v in power.items()})
    w = dict(own)
    for _ in range(mixing.ROUNDS):
        for d, target in enumerate(targets):
            sums: dict = {}
            for k, x in w.items():
                sums[k[d]] = sums.get(k[d], 0) + x
            w = {k: x * target[k[d]] / sums[k[d]] if sums[k[d]] else 0 for k, x in w.items()}
    classes: dict = {}
    for k, x in w.items():
        c = math.floor(math.log2(x / own[k]) * mixing.CLASSES)
        classes.setdefault(c, []).append(k)
    held, most = 0, None
    for c in sorted(classes, reverse=True):
        held += sum(own[k] for k in classes[c])
        if held / total > MIX_CLIP:
            most = max(w[k] / own[k] for k in classes[c])
            break
    chance = {k: round(min(1.0, w[k] / own[k] / most), 9) for k in w}
    draw = lambda d: int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:12], 16) / 16**12
    return [r[0] for r, k in zip(rows, keys, strict=True) if draw(r[0]) < chance[k]]


def test_stages(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, path), "test-stage")
        assert docs.columns == columns
    want = expected(rows)
    assert sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, path)
    assert mixed.columns == columns
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(mixture(want))


def test_run(spark, corpus):
    path, _ = corpus
    got = corpus_pipeline.run(spark, path).collect()
    assert got and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got[0].asDict())
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for pieces in by_doc.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == pieces[0][2]


def test_stages_take_empty_tables_and_busy_names(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    busy = docs.selectExpr("*", "1 AS n_words", "'x' AS removed", "2.5 AS probability", "'y' AS spans", "'z' AS topic", "3 AS tokens")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).count() == 0
        out = stage(spark, busy, path)
        assert out.columns == busy.columns and {(r["n_words"], r["removed"], r["spans"], r["topic"], r["tokens"]) for r in out.collect()} == {(1, "x", "y", "z", 3)}
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), path).count() == 0


def test_quality_stage_removes_frequent_lines(spark):
    rows = [(i, f"{' '.join(words(i, 60))}\nAll Rights  reserved here\n\n{' '.join(words(900 + i, 5))}", "en", "h", 0) for i in range(30)]
    rows += [(100, f"{' '.join(words(100, 60))}\nall rights reserved here", "en", "other", 0), (5, *rows[5][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality_rules(spark, docs, "").collect()
    want = [(d, t.replace("\nAll Rights  reserved here", "")) for d, t, *_ in rows]
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_quality_stage_removes_lines_of_a_small_share(spark):
    rows = [(i, " ".join(words(i, 60)) + ("\nsite footer" if i < 25 else ""), "en", "h", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert len(got) == 400 and not any("site footer" in r["text"] for r in got)
