import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoteloom.llm.merkle import Shape, folded, levels, matrix, merkle_manifest, paths, siblings, strings

from .helpers import AWKWARD, DOCS, documents


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def fold(nodes, fanout):
    """The root of a list of digests, and for each of them the siblings of each level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, node in enumerate(at):
            first = node // fanout * fanout
            ways[leaf].append((nodes[first:node], nodes[node + 1 : first + fanout]))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [x // fanout for x in at]
    return nodes[0], ways


def brute(rows, fanout=3, changed=lambda doc_id, text: text):
    """Manifest rows of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = lambda t: H(*map(told, (doc_id, source, lang, n_chars, t)))  # noqa: B023, E731
        groups.setdefault(source, []).append((doc_id, leaf(text), leaf(changed(doc_id, text))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: fold([x[1] for x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for s in order}
    root, outer = fold([inner[s][0] for s in order], fanout)
    out = []
    for s, above in zip(order, outer):
        for (doc_id, leaf, now), way in zip(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), inner[s][1]):
            for left, right in way + above:
                now = H(*left, now, *right)
            out.append((doc_id, leaf, inner[s][0], root, H(*[h for left, right in way + above for h in left + right]), now, now == root))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.integers(2, 4))
def test_one_block_equals_plain_folding(n, fanout):
    leaves = [H(str(i)) for i in range(n)]
    import pyarrow as pa

    tree = levels(matrix(pa.array(leaves)), fanout, 9, True)
    root, ways = fold(leaves, fanout)
    assert strings(tree[-1]).to_pylist() == [root]
    found, there = siblings(tree, fanout)
    left, right = paths(tree, fanout)
    for i, way in enumerate(ways):
        assert bytes(found[i][there[i]].reshape(-1)).decode() == "".join("".join(a + b) for a, b in way)
        assert (left[i], right[i]) == (["".join(a) for a, _ in way], ["".join(b) for _, b in way])
    assert all(bytes(x).decode() == root for x in folded(tree, tree[0], fanout))
    other = np.roll(tree[0], 1, axis=0)
    if n > 1:
        assert all(bytes(x).decode() != root for x in folded(tree, other, fanout))


def test_a_block_of_fixed_height_hashes_a_lone_node_again():
    import pyarrow as pa

    tree = levels(matrix(pa.array([H("a")])), 3, 2, False)
    assert strings(tree[-1]).to_pylist() == [H(H(H("a")))]


@pytest.mark.parametrize("shape", [Shape(3, 1), Shape(2, 2), Shape(3, 7)])
def test_blocks_of_any_size_give_the_same_manifest(spark, shape):
    rows = [(i * 7 % 100, f"text\n{i}", "en" if i % 3 else None, None if i % 5 == 0 else f"s{'é' if i % 2 else 'z'}{min(3, i % 11)}", i if i % 4 else None) for i in range(100)]
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle_manifest(spark.createDataFrame(rows, DOCS).repartition(3), changed=(even, {"text": F.expr(r"replace(text, '\n', '')")}), shape=shape)
    want = brute(rows, shape.fanout, lambda d, t: t.replace("\n", "") if zlib.crc32(str(d).encode()) % 2 == 0 else t)
    assert rows_of(found) == sorted(want, key=str)
    assert 0 < sum(r[-1] for r in want) < 100


def test_one_group_and_many_groups(spark):
    one = [(i, str(i), None, "s", 1) for i in range(40)]
    many = [(i, str(i), None, f"s{i:03}", 1) for i in range(40)]
    for rows in (one, many, one[:1]):
        assert rows_of(merkle_manifest(spark.createDataFrame(rows, DOCS), shape=Shape(3, 1))) == sorted(brute(rows), key=str)


def test_awkward_rows(spark):
    rows = [(d, t, None, "s", len(t or "")) for d, t in AWKWARD]
    found = rows_of(merkle_manifest(documents(spark, AWKWARD)))
    assert found == sorted(brute(rows), key=str) and all(r[-1] for r in found)


def test_a_null_is_no_text(spark):
    leaf = [r.leaf for r in merkle_manifest(spark.createDataFrame([(1, None, "", "s", 0), (1, "", None, "s", 0), (1, "-", "-", "s", 0)], DOCS)).collect()]
    assert len(set(leaf)) == 3


def test_empty_table(spark):
    assert merkle_manifest(documents(spark, [])).collect() == []


def test_shapes_without_levels_are_refused():
    for bad in ((1, 3), (3, 0)):
        with pytest.raises(ValueError, match="two at a time"):
            Shape(*bad)


def test_equals_its_sql(spark, sf_dir, duck):
    from quoteloom.llm.queries import ORACLES, QUERIES

    found = QUERIES["op13_merkle"](spark, sf_dir)
    want = duck.execute(ORACLES["op13_merkle"])
    assert [d[0] for d in want.description] == found.columns
    assert rows_of(found) == sorted(want.fetchall(), key=str)
