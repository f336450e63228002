import pyarrow as pa
from labelflow.operators.portions import bounds, portions, row_portions


def test_portions_cover_a_batch_within_their_limits():
    texts = ["ab", None, "x" * 50, "", "漢" * 10, *["y"] * 30]
    for rows, size in ((4, 1000), (100, 40), (100, 5), (1, 1)):
        cut = list(bounds(pa.array(texts), rows, size))
        assert [i for at, n in cut for i in range(at, at + n)] == list(range(len(texts)))
        for at, n in cut:
            assert 1 <= n <= rows
            assert n == 1 or sum(len((t or "").encode()) for t in texts[at : at + n]) <= size
    assert list(bounds(pa.array([], pa.string()))) == []


def test_parts_of_sliced_batches_keep_their_rows():
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "text": ["z" * 700] * 3000}).slice(100, 2500)
    for parts in (list(portions(batch, "text")), list(row_portions(batch))):
        assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
        assert len(parts) == 5
