"""Groups of the near-copy join: lists that lie within one another."""

from clipfleet.llm import ngram_join


def test_nested_lists_become_one_group(spark):
    size = 20  # list t holds the members t, t + 1, ... as lists of ever shorter copies do
    rows = [(1, t, size - t, f"m{t}", i, 100 - i, i, 10 + i) for t in range(size - 1) for i in range(t, size)]
    lists = spark.createDataFrame(rows, "gid long, t long, k long, members string, id long, n long, lab long, d int")
    got = ngram_join._next_groups(lists).collect()
    assert len(got) <= 2 * size
    groups = {}
    for r in got:
        groups.setdefault(r.gid, {r.pid}).add(r.id)
    assert all({i, j} <= max(groups.values(), key=len) for i in range(size) for j in range(i))
    assert all(r.id != r.pid for r in got)


def test_lists_that_share_no_member_stay_apart(spark):
    rows = [(1, t, 3, f"m{t}", 10 * t + i, 50, 10 * t + i, 10 + i) for t in range(3) for i in range(3)]
    lists = spark.createDataFrame(rows, "gid long, t long, k long, members string, id long, n long, lab long, d int")
    got = ngram_join._next_groups(lists).collect()
    assert {(r.pid, r.id) for r in got} == {(10 * t, 10 * t + i) for t in range(3) for i in (1, 2)}
