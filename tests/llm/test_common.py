import pyarrow as pa
import pytest

from riffle.llm import common, near_duplicates, repeated_windows

TEXTS = ["one two", None, "", "é" * 30, "x" * 100, "y", None, "last words here"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary()])
@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_slices_and_steps_give_every_row_once(kind, most):
    column = pa.array([None if t is None else t.encode() for t in TEXTS], pa.binary()).cast(kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), column], ["key", "text"])
    keys, texts = [], []
    for part in common.parts(iter([batch]), most=most):
        keys += part.column("key").to_pylist()
        for step in common.steps(part.column("text"), 5):
            texts += [step.text(i) for i in range(step.rows)]
    assert keys == list(range(len(TEXTS))) and texts == [(t or "").encode() for t in TEXTS]


def test_lists_of_a_slice():
    column = pa.array([[1], None, [2, 3], [], [4]], pa.list_(pa.int64())).slice(1, 4)
    values, starts = common.list_slices(column)
    assert values.tolist() == [2, 3, 4] and starts.tolist() == [0, 0, 2, 2, 3]


def test_words_do_not_cross_rows():
    step = next(common.steps(pa.array(["ab", "cd ef", "", " g "])))
    found = common.words(step)
    assert [bytes(step.data[a:b]) for a, b in zip(found.begin, found.end)] == [b"ab", b"cd", b"ef", b"g"]
    assert found.starts.tolist() == [0, 1, 3, 3, 4]
    same = common.words(next(common.steps(pa.array(["ab cd", "cd ab"]))))
    assert same.hash.tolist() == same.hash[[3, 2, 1, 0]].tolist()


def two_alike():
    """Two words of 1,024 letters that every polynomial hash with an odd base modulo 2 ** 64 takes for one."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_different_words_have_different_hashes(spark):
    a, b = two_alike()
    found = common.words(next(common.steps(pa.array([f"{a} {b} x{a}", a]))))
    assert len(set(found.hash.tolist())) == 3 and found.hash[0] == found.hash[3]
    docs = spark.createDataFrame([(1, f"one two {a} four"), (2, f"one two {b} four")], "doc_id long, text string")
    assert all(r.kept for r in near_duplicates.label_near_duplicates(docs, size=5, percent=85).collect())
    same = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{same} {a} {same}"), (2, f"{same} {b} {same}")], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in repeated_windows.remove_repeated(docs, window=35).collect())
