import tracemalloc

import numpy as np
import pyarrow as pa

from contentfit.llm.common import free_name, run_hashes, shingle_set, slices, word_hashes, word_spans


def hashes(text: bytes):
    buf = np.frombuffer(text, dtype=np.uint8)
    return word_hashes(buf, *word_spans(buf))


def test_hash_depends_on_the_word_alone(prose_of):
    text = prose_of(1, 500).encode() + b" " + b"longword" * 9 + b" \t\n x"
    words = text.split()
    got = hashes(text)
    assert len(got) == len(words)
    assert [int(h) for h in got] == [int(hashes(w)[0]) for w in words]
    assert len(set(got.tolist())) == len(set(words))


def test_piece_edges():
    words = [b"a" * n for n in range(1, 40)] + [b"\x00" * n for n in range(1, 40)]
    got = [int(word_hashes(np.frombuffer(w, dtype=np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    assert len(set(got)) == len(words)
    empty = word_hashes(np.empty(0, dtype=np.uint8), np.array([0]), np.array([0]))
    assert len(empty) == 1


def thue_morse(a: str, b: str, n: int, join: str = "") -> str:
    return join.join(b if bin(i).count("1") & 1 else a for i in range(n))


def test_no_collision_of_mirrored_sequences():
    """Polynomials modulo 2^64 give these pairs one value whatever the base."""
    for n in (1024, 4096):
        x, y = thue_morse("a", "b", n), thue_morse("b", "a", n)
        assert hashes(x.encode())[0] != hashes(y.encode())[0]
        assert shingle_set(np.frombuffer(x.encode(), np.uint8), 4).tolist() != shingle_set(np.frombuffer(y.encode(), np.uint8), 4).tolist()
        u, v = hashes(thue_morse("a", "b", n, " ").encode()), hashes(thue_morse("b", "a", n, " ").encode())
        assert run_hashes(u, np.array([0]), np.array([n]))[0] != run_hashes(v, np.array([0]), np.array([n]))[0]


def test_runs_are_told_apart_by_their_words():
    words = hashes(b"a b c a b c b a")
    got = run_hashes(words, np.array([0, 3, 6]), np.array([3, 6, 8]))
    assert got[0] == got[1] != got[2]
    assert run_hashes(words, np.array([0]), np.array([2]))[0] != run_hashes(words, np.array([6]), np.array([8]))[0]


def test_memory_of_one_huge_word():
    buf = np.frombuffer(b"z" * (24 << 20), dtype=np.uint8)
    tracemalloc.start()
    hashes_ = word_hashes(buf, np.array([0]), np.array([len(buf)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes_) == 1 and peak < 120 << 20


def test_slices_and_free_names():
    batch = pa.RecordBatch.from_pydict({"a": ["x" * 1000] * 100})
    parts = list(slices(batch, 10_000))
    assert sum(p.num_rows for p in parts) == 100 and len(parts) > 5
    assert list(slices(batch.slice(0, 0))) == []
    assert free_name("id", ["ID", "id_", "x"]) == "id__" and free_name("q", []) == "q"
