"""What a worker holds at once."""

from __future__ import annotations

import threading
import time
from pathlib import Path

import psutil
from pyspark.sql import functions as F

from loadscope.llm import bpe, nearcopies
from loadscope.llm.queries import vocabulary


def test_a_batch_is_held_once(spark):
    """One task's batch of 60 MB of text, whose shingle sets are as large: a worker grows by the batch, not by four times that."""
    docs = spark.range(6000).select(F.expr("concat_ws(' ', transform(sequence(1, 1000), k -> concat('w', (id * 7919 + k * k) % 100003000)))").alias("text")).coalesce(1)
    workers = lambda: {p.pid: p.memory_info().rss >> 20 for c in psutil.Process().children() for p in c.children(recursive=True)}
    before, most, done = workers(), [0], threading.Event()

    def watch():
        while not done.wait(0.03):
            most[0] = max([most[0], *(now - before.get(pid, 110) for pid, now in workers().items())])

    (thread := threading.Thread(target=watch)).start()
    began = time.time()
    total = docs.select(nearcopies._sets(F.col("text")).alias("own")).agg(F.sum(F.octet_length("own"))).first()[0]
    done.set()
    thread.join()
    assert total == 6000 * 996 * 8 and time.time() - began < 120
    assert most[0] < 130


def test_tokens_at_ends_are_no_nodes():
    """Many tokens continue to no other, most are merged with no other from the left: nothing but the token is kept for these."""
    automaton = bpe.Tokenizer.parsed(Path(vocabulary()).read_text(encoding="utf-8")).automaton
    nodes, todo = 0, [automaton.trie]
    while todo:
        nodes += 1
        todo += [x for x in todo.pop().values() if isinstance(x, dict)]
    assert nodes < 1.5 * len(automaton.labels) and len(automaton.versions) < 0.5 * len(automaton.labels)
