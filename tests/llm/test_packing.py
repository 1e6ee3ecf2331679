import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kerbside.llm.packing import OpenBins, pack_announcements
from tests.llm.fixtures import prose, rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def pack(spark, rows, **more):
    return pack_announcements(spark.createDataFrame(rows, "route_id long, text string, piece int, deal string"), PATH, **more)


def test_pieces_round_trip_and_sequences_are_gapless(spark):
    rng, whole = random.Random(5), Tokenizer.from_file(PATH)
    texts = [prose(rng, rng.choice([1, 5, 60, 400])) for _ in range(150)]
    texts += ["", None, "Ünïcödé space   and́ it's we're 12345", "x" * 5000, "word " * 9000, "don't stop\n\nnow!!"]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts)] + [(3, texts[3], 1, "z"), (None, "lost", 1, "z")]
    got = pack(spark, rows, length=256).collect()
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    ids[None] = whole.encode("lost", add_special_tokens=False).ids + [0]
    assert len(got) == sum(-(-len(ids[r[0]]) // 256) for r in rows)
    places = {}
    for r in got:
        part = ids[r["route_id"]][r["start"]: r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and len(part) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(len(ids[r[0]]) for r in rows)
    assert len(places) <= 1.1 * total / 256 + 1
    assert rows_of(pack(spark, rows, length=256)) == sorted((tuple(r) for r in got), key=repr)


def test_best_fit_and_the_fullest_bin_closes():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]     # 3 fits both, best in the fuller
    assert [bins.place(n) for n in (9, 8)] == [(2, 0), (3, 0)]                # three open: the one with 1 free closes
    assert bins.place(2) == (3, 8) and bins.place(1) == (0, 6) and bins.place(10) == (4, 0)


def test_empty_table(spark):
    assert rows_of(pack(spark, [])) == []
