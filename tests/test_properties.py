"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import coding
from palimpsest.functions.steps import step_range
from palimpsest.operators.differences import _check, _places, peel
from palimpsest.operators.intervals import IntervalMap
from palimpsest.sources import kvseg

ranges = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), max_size=40)


@given(ranges)
def test_interval_map_covers_what_was_put_in(data):
    m = IntervalMap()
    for a, b in data:
        m.insert(a, b)
    covered = {x for a, b in data for x in range(a, b)}
    assert {x for a, b in m.periods() for x in range(a, b)} == covered
    assert all(a < b for a, b in m.periods() + m.gaps())
    assert not {x for a, b in m.gaps() for x in range(a, b)} & covered


@given(st.lists(st.binary(max_size=40), max_size=60), st.booleans())
@settings(max_examples=50, deadline=None)
def test_words_round_trip(words, compress):
    assert [w for _, w in kvseg.WordFile(kvseg.encode_words(words, compress)).words()] == words


@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=600).map(sorted))
@settings(deadline=None)
def test_monotone_sequences(values):
    assert coding.EliasFano(coding.ef_encode(values)).values().tolist() == values


@given(st.integers(0, 2**64 - 1), st.binary(max_size=5))
def test_uvarint(n, more):
    code = coding.uvarint(n)
    assert coding.read_uvarint(b"xx" + code + more, 2) == (n, len(code))


@given(st.lists(st.tuples(st.integers(1, 1000), st.integers(0, 5000)), min_size=2, max_size=80, unique_by=lambda s: s[1]))
def test_huffman_is_a_whole_prefix_code(symbols):
    built = coding.huffman(symbols)
    assert sorted(i for i, _, _ in built) == list(range(len(symbols)))
    assert coding.codes_from_depths([d for _, d, _ in built]) == [c for _, _, c in built]
    assert sum(2**-d for _, d, _ in built) == 1


@given(st.integers(0, 2**63), st.integers(0, 2**63))
def test_step_names(a, b):
    assert step_range(f"v1.x.{a}-{b}.kv") == (a, b)


signed = st.integers(-(2**63), 2**63 - 1)


@given(st.lists(st.tuples(signed, signed, st.sampled_from([1, -1, 2, -3, 7])), max_size=120, unique_by=lambda r: r[1]))
@settings(deadline=None)
def test_peeling_finds_every_row(rows):
    """A row put in several times comes out once."""
    cells = {}
    for kh, rh, n in rows:
        for c in _places(rh):
            cell = cells.setdefault(c, [0] * 6)
            k, r = kh & (2**64 - 1), rh & (2**64 - 1)
            for i, x in enumerate((1, k >> 32, k & 0xFFFFFFFF, r >> 32, r & 0xFFFFFFFF, _check(kh, rh))):
                cell[i] += n * x
    found, whole = peel(cells)
    assert not whole or sorted(found) == sorted(kh for kh, _, _ in rows)
