"""Tags of an Arrow batch are decoded in slices, with the results of the whole."""

import random

import pandas as pd
import pyarrow as pa

from palimpsest.operators import contextual

TOKEN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("mask", pa.int32()), ("tag", pa.string()), ("score", pa.float64())])


def test_slices_give_what_the_whole_gives(monkeypatch):
    rng = random.Random(3)
    texts, tokens = [], []
    for i in range(400):
        n = rng.choice([0, 1, 5, 40]) if i != 200 else 900
        texts.append(None if i % 50 == 7 else "é word " * n)
        own = [{"start": 7 * k, "end": 7 * k + 6, "mask": int(rng.random() < 0.9), "tag": rng.choice(["B-x", "I-x", "E-x", "O", "y", ""]), "score": rng.random()} for k in range(n)]
        tokens.append(None if i % 60 == 9 else own)
    want = contextual._decoded(pd.Series(texts), pd.Series(tokens)).tolist()
    sizes, whole = [], contextual._decoded

    def counted(text, own):
        sizes.append((len(own), sum(len(o) for o in own if o is not None)))
        return whole(text, own)

    monkeypatch.setattr(contextual, "_decoded", counted)
    monkeypatch.setattr(contextual, "SLICE_TOKENS", 100)
    got = contextual._sliced(pa.array(texts, pa.string()), pa.array(tokens, pa.list_(TOKEN))).to_pylist()
    assert got == want and any(got)
    assert all(rows == 1 or n <= 100 for rows, n in sizes) and max(n for _, n in sizes) == 900
    assert contextual._sliced(pa.array([], pa.string()), pa.array([], pa.list_(TOKEN))).to_pylist() == []
