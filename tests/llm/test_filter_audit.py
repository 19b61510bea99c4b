"""The audit of filter orders against applying the filters one by one."""

import collections
import itertools
import re

import numpy as np
import pytest

from mergelight.llm import filter_audit as fa


def brute_force(rows, labels):
    """Every order applied filter by filter, over documents."""
    good, toxic = ({i for i, *v in labels if i is not None and v[at] == 1} for at in (0, 1))
    least = {}
    for i, text, _ in rows:
        key, now = text or "", float("-inf") if i is None else i
        least[key] = min(least.get(key, now), now)
    parts = collections.defaultdict(list)
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": (float("-inf") if i is None else i) > least[t],
        }
        parts[part or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left, before = docs, []
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[0][f] for d in before),
                    sum(d[0][f] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
                before = before + gone
        for f in "ABCDE":
            keys = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(total)
    return out


def as_dict(result):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in result.collect()}


def test_all_orders_equal_brute_force(spark, odd_docs, odd_rows):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (8, 1, 1), (9, None, 1), (None, 1, 1), (999, 1, 1), (101, 1, 0), (205, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = as_dict(fa.filter_audit(odd_docs, table))
    assert got == brute_force(odd_rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in odd_rows})


def test_no_labels_and_no_rows(spark, odd_docs, odd_rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert as_dict(fa.filter_audit(odd_docs, labels)) == brute_force(odd_rows, [])
    assert fa.filter_audit(odd_docs.limit(0), labels).count() == 0


def test_one_text_in_most_rows(spark):
    """A text that is more than 1/1000 of all rows is looked up by broadcast, the others by join."""
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    assert as_dict(fa.filter_audit(docs, labels)) == brute_force(rows, [(3, 1, 1)])


@pytest.mark.parametrize("names", ["A", "AB", "ABC", "ABCDE"])
def test_removal_steps_are_the_first_failing_step(names):
    orders, positions = fa.position_matrix(names)
    fails = (np.arange(1 << len(names))[:, None] >> np.arange(len(names)) & 1).astype(bool)
    steps = fa.removal_steps(fails, positions)
    for m, mask in enumerate(fails):
        for o, order in enumerate(orders):
            failing = [s for s, f in enumerate(order, 1) if mask[names.index(f)]]
            assert steps[m, o] == (failing[0] if failing else len(names) + 1)


def test_cells_of_two_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 1), ("p", 3, 2, 0, 2)],
                                  "part string, mask int, n long, good long, toxic long")
    got = as_dict(fa.audit_cells(cells, "XY"))
    assert got == {
        ("p", "XY", 1): [5, 5, 0, 3, 1, 3, 8], ("p", "XY", 2): [5, 0, 2, 0, 0, 0, 2],
        ("p", "YX", 1): [8, 2, 0, 0, 0, 2, 2], ("p", "YX", 2): [5, 3, 2, 3, 1, 1, 8],
    }
