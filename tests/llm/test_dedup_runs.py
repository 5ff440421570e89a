"""What op 1 sends: spans joined by text before they leave a task, runs in few batches, the same merge."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from strandframe.llm import suffix_dedup as sd


def test_joined_spans_are_the_plain_union_of_each_key():
    rng = random.Random(1)
    keys = [hashlib.md5(bytes([k])).digest() for k in range(5)]
    spans = [(rng.choice(keys), a, a + rng.choice((1, 5, 60))) for a in (rng.randrange(2000) for _ in range(300))]
    k, a, b = sd.joined(np.frombuffer(b"".join(x[0] for x in spans), "V16"), np.array([x[1] for x in spans]), np.array([x[2] for x in spans]))
    plain = {(key, *r) for key in keys for r in sd.union_of([x[1:] for x in spans if x[0] == key])}
    assert set(zip(k, a.tolist(), b.tolist(), strict=True)) == plain and len(k) == len(plain) < 250
    assert sd.joined(np.zeros(0, "V16"), np.zeros(0, np.int64), np.zeros(0, np.int64))[0] == []


def test_merge_orders_entries_and_keeps_common_prefixes():
    rng = random.Random(2)
    for runs in (1, 2, 3, 7, 12):
        made = [[(bytes(rng.choices(b"ab", k=rng.randrange(12))), b"", bytes(24)) for _ in range(rng.randrange(40))] for _ in range(runs)]
        merged = list(sd.merge_runs([sd.read_run(sd.write_run(list(x))[0]) for x in made]))
        assert [m[1] for m in merged] == sorted(e for x in made for e in {y[0] for y in x})
        for before, entry in zip(merged, merged[1:], strict=False):
            assert entry[0] == sd.common(before[1], entry[1])


def test_a_task_sends_a_span_for_a_repeated_passage_not_one_for_each_anchor(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    passage = text(5000)
    docs = spark.createDataFrame([(k, text(300) + passage + text(300)) for k in range(6)], "doc_id long, text string").coalesce(1)
    sampled = sd._sampled(docs, 240)
    each = sampled.select("key", "doc_id", F.explode(F.arrays_zip("zone", "pos", "lo", "hi", "hash")).alias("e")).select("key", "doc_id", "e.*")
    found = sd._with_text(docs, sd._by_text(each)).repartition(1)
    runs = sd._runs(found, 8, 240).collect()
    spans = [r for r in runs if r.run is None]
    assert len({r.key for r in spans}) == 6 == len(spans)  # each text has the passage only
    assert all(r.a <= 300 + 240 and r.b >= 5300 - 240 for r in spans)
    assert all(r.a is None for r in runs if r.run is not None)
