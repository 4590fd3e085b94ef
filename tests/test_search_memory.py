"""What a worker holds while it lists trigrams is bounded, whatever the texts of a batch have together."""

import pyarrow as pa

from fleetlens.operators import search_index


def test_trigrams_come_in_slices():
    texts = ["".join(chr(97 + (k * i) % 4099) for i in range(3_000)) for k in range(1, 400)] + ["ab", ""]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "field": ["f"] * len(texts), "v": texts})
    got, largest = set(), 0
    for out in search_index._grams(iter([batch])):
        largest = max(largest, out.num_rows)
        got |= set(zip(out["id"].to_pylist(), out["gram"].to_pylist(), strict=True))
    assert got == {(k, t[i : i + 3]) for k, t in enumerate(texts) for i in range(len(t) - 2)}
    assert len(got) > 1_000_000 and largest < search_index.BATCH_GRAMS + 3_000
