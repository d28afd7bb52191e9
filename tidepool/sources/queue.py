"""A message queue as a stream: received in small polls, deleted once its batch is committed.

    spark.dataSource.register(QueueSource)
    spark.readStream.format("queue").option("client", "my_module:connect").option("perTrigger", 5000).load()

``client`` names a function of the options that returns a client with
``receive(most) -> [(receipt, key, payload)]`` and ``delete(receipts)``.
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Messages asked for in one poll.
POLL = 10


class QueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "queue"

    def schema(self) -> str:
        return "key string, payload string, ts timestamp, seq long"

    def simpleStreamReader(self, schema) -> QueueReader:
        return QueueReader(dict(self.options))


class QueueReader(SimpleDataSourceStreamReader):
    """Delivers at least once: what wasn't committed comes again, and upserts make that harmless.

    ``seq`` numbers messages in the order in which they were received.
    """

    def __init__(self, options: dict[str, str]):
        module, func = options["client"].split(":")
        self.client = getattr(importlib.import_module(module), func)(options)
        self.per_trigger = int(options.get("perTrigger", 1000))
        self.held: list[tuple[int, str, tuple]] = []  # (seq, receipt, row), not committed yet

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def _poll(self, start: int, most: int) -> list[tuple]:
        rows = []
        while len(rows) < most and (got := self.client.receive(min(POLL, most - len(rows)))):
            for receipt, key, payload in got:
                seq = start + len(rows)
                rows.append((key, payload, datetime.now(timezone.utc), seq))
                self.held.append((seq, receipt, rows[-1]))
        return rows

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._poll(start["seq"], self.per_trigger)
        return iter(rows), {"seq": start["seq"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        known = [row for seq, _, row in self.held if start["seq"] <= seq < end["seq"]]
        if known:
            return iter(known)
        # after a restart the queue itself delivers again what wasn't deleted
        return iter(self._poll(start["seq"], end["seq"] - start["seq"]))

    def commit(self, end: dict) -> None:
        self.client.delete([receipt for seq, receipt, _ in self.held if seq < end["seq"]])
        self.held = [h for h in self.held if h[0] >= end["seq"]]


class FolderQueue:
    """A queue of files in a folder, oldest first: for tests and for handing over between jobs."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.given = options["folder"], set()
        os.makedirs(self.folder, exist_ok=True)

    def send(self, key: str, payload: str) -> None:
        name = f"{len(os.listdir(self.folder)):09d}-{uuid.uuid4().hex}"
        with open(f"{self.folder}/.{name}", "w") as out:
            json.dump([key, payload], out)
        os.rename(f"{self.folder}/.{name}", f"{self.folder}/{name}.json")

    def receive(self, most: int) -> list[tuple[str, str, str]]:
        names = [n for n in sorted(os.listdir(self.folder)) if n.endswith(".json") and n not in self.given][:most]
        self.given.update(names)
        out = []
        for n in names:
            with open(f"{self.folder}/{n}") as src:
                out.append((n, *json.load(src)))
        return out

    def delete(self, receipts: list[str]) -> None:
        for n in receipts:
            if os.path.exists(f"{self.folder}/{n}"):
                os.remove(f"{self.folder}/{n}")
