import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from bandwarden.llm import lattice_lm as L

from . import brute


def brute_base(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    texts = [(d, [*brute.words(t, lower=True), None], d is not None and zlib.crc32(str(d).encode()) % 5 == 1) for d, t in rows]
    counts = Counter(w for _, ws, held in texts if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {d: (held, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in ws))
            for d, ws, held in texts}


def strings(pieces_path):
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    out = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    return [s.replace("▁", " ").encode() for i, s in enumerate(out)
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or "▁" in s[1:] or m.get_score(i) < -1e8)]


def test_lattice_sums_all_segmentations():
    pieces = L.load_pieces(L.vocabulary_path())
    names = strings(L.vocabulary_path())
    p = {s: pieces.start[i] for i, s in enumerate(names)}
    texts = [w.encode() for w in ("the", "thing", "été", "x", "日本", "internationalisation", "zzzzzzzz")]

    @lru_cache(None)
    def total(raw):
        if not raw:
            return 1.0
        got = pieces.start[pieces.first_byte + raw[0]] * total(raw[1:])
        return got + sum(p.get(raw[:k], 0) * total(raw[k:]) for k in range(1, len(raw) + 1))

    flat = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    got = L.word_scores(pieces, pieces.start, flat, np.cumsum(lengths) - lengths, lengths)
    assert np.allclose(got, [math.log(total(b" " + t)) for t in texts])
    uses = L.expected_counts(pieces, pieces.start, flat, np.cumsum(lengths) - lengths, lengths, np.ones(len(texts)))
    size = np.array([*[len(s) for s in names], *[1] * 256, 0])
    assert abs(uses @ size - (lengths.sum() + len(texts))) < 1e-6  # every segmentation spells its word


def test_counts_and_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in L.lattice_scores(docs).collect()}
    want = brute_base(rows)
    assert set(got) == set(want)
    for d, (held, n, known, tokens, base) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, tokens)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and -1e7 < r.score < 0
    again = {r.doc_id: r.score for r in L.lattice_scores(docs.repartition(7)).collect()}
    assert all(abs(again[d] - got[d].score) < 1e-6 * abs(got[d].score) for d in got)


def test_small_chunks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_ROWS", 2)
    rows = [(i, t) for i, t in enumerate(["The cat", "the CAT sat", None, "", "été cat", "x" * 3000, "dog the", "a b c d"])] + [(None, "the")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, chunk int, hash int")
    got = {r.doc_id: r for r in L.lattice_scores(docs).collect()}
    for d, (held, n, known, tokens, base) in brute_base(rows).items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, tokens)
        assert r.base_score == pytest.approx(base) and math.isfinite(r.score)
    assert len(L.lattice_scores(docs.union(docs.limit(1))).collect()) == len(rows) + 1
    assert L.lattice_scores(docs.where("false")).count() == 0
    held = [d for d in range(40) if zlib.crc32(str(d).encode()) % 5 == 1]
    only = spark.createDataFrame([(d, "q r") for d in held], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens) for r in L.lattice_scores(only).collect()} == {(0, 0)}
