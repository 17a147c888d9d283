"""Placement against the rule, worked out apart from the operator."""

import hashlib

from tidewatch.llm import sharding


def test_against_brute_force(spark):
    names, size = [f"s{i}" for i in range(5)], 101
    orders = []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
    owner: dict[int, str] = {}
    while len(owner) < size:
        for name, order in zip(names, orders):
            free = [slot for slot in order if slot not in owner]
            if free:
                owner[free[0]] = name
    keys = [*range(-50, 400), 2**53 + 1, None]
    got = sharding.place(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", names, size).collect()
    assert len(got) == len(keys)
    for r in got:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % size
        assert (r["slot"], r["shard"]) == (slot, owner[slot])
