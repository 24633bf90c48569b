"""The map service as a data source: ``spark.read.format("map_service")`` gives records, images or heights of a table of requests."""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from farpoint.sources import imagery, records, service, survey

PIXELS = "id string, h int, w int, pixels array<float>"
SCHEMAS = {"records": "id string, " + ", ".join(f"{c} string" for c in records.FIELDS.values()), "images": PIXELS, "heights": PIXELS}
#: Requests of a partition, about, and the bytes of output that a batch holds.
EACH, BATCH_BYTES = 500, 32 << 20


@dataclass
class Requests(InputPartition):
    """Rows of the request table."""

    #: (file, first row, end)
    rows: list[tuple[str, int, int]]
    #: Place among the partitions, their number, and the time (since 1970) of the first slot.
    place: int
    of: int
    began: float


def named(path: str):
    """The function at "module:name"."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class MapReader(DataSourceReader):
    """Plans a partition for each EACH rows of the request table's files, and asks for what is not kept."""

    def __init__(self, options: dict):
        self.options, self.ids = dict(options), None
        self.kind = options["kind"]

    def place(self, option: str):
        return fs.FileSystem.from_uri(self.options[option]) if "://" in self.options[option] else (fs.LocalFileSystem(), self.options[option].removeprefix("file:"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ids that are asked for by = or IN: no request is made for the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = wanted if self.ids is None else self.ids & wanted
            else:
                yield f

    def partitions(self) -> list[Requests]:
        store, path = self.place("requests")
        files = [f for f in ds.dataset(path, filesystem=store, format="parquet").files]
        counts = {f: pq.read_metadata(store.open_input_file(f)).num_rows for f in sorted(files)}
        plan = [(f, i, min(i + EACH, n)) for f, n in counts.items() for i in range(0, n, EACH)]
        # slots of the rate belong to partitions, so all of these should run at once
        n = len(plan) if float(self.options.get("per_second", 2.0)) <= 0 else min(len(plan), int(self.options.get("slots", 8)))
        return [Requests(plan[i::n], i, n, time.time()) for i in range(n)]

    def read(self, part: Requests) -> Iterator[pa.RecordBatch]:
        for file, start, stop in part.rows:
            yield from self.answers_to(file, start, stop, part)

    def answers_to(self, file: str, start: int, stop: int, part: Requests) -> Iterator[pa.RecordBatch]:
        source, _ = self.place("requests")
        rows = pq.read_table(source.open_input_file(file), columns=["id", "params"]).slice(start, stop - start)
        if self.ids is not None:
            rows = rows.filter(pc.is_in(rows["id"], pa.array(sorted(self.ids), pa.string())))
        params = [(i, json.loads(p)) for i, p in zip(rows["id"].to_pylist(), rows["params"].to_pylist(), strict=True) if p is not None]
        asked = {service.request_key(p): p for _, p in params}
        bodies = self.kept(asked)
        new = dict(self.answered({k: p for k, p in asked.items() if k not in bodies}, part))
        self.keep(new)
        bodies |= new
        yield from self.batches([(i, bodies.get(service.request_key(p))) for i, p in params])

    def kept(self, asked: dict[str, dict]) -> dict[str, bytes]:
        store, path = self.place("store")
        if store.get_file_info(path).type != fs.FileType.Directory or not asked:
            return {}
        have = ds.dataset(path, filesystem=store, format="parquet", schema=pa.schema({"key": pa.string(), "body": pa.binary()})).to_table(filter=pc.field("key").isin(list(asked)))
        return dict(zip(have["key"].to_pylist(), have["body"].to_pylist(), strict=True))

    def answered(self, asked: dict[str, dict], part: Requests) -> Iterator[tuple[str, bytes]]:
        """Answers, with attempt n of this partition no sooner than slot ``n * of + place`` of the whole job's rate."""
        transport = named(self.options["transport"])(self.options) if asked else None
        rate, queue = float(self.options.get("per_second", 2.0)), service.Queue(list(asked.items()), transport)
        if rate <= 0:
            yield from service.tried(queue)
            return
        while queue.waiting:
            n = max(0, -int(-((time.time() - part.began) * rate - part.place) // part.of))
            time.sleep(max(0.0, part.began + (n * part.of + part.place) / rate - time.time()))
            time.sleep(max(0.0, queue.waiting[0][0] - time.monotonic()) and part.of / rate)
            if (got := queue.attempt(time.monotonic())) is not None:
                yield got
            time.sleep(min(0.5 * part.of / rate, 0.05))  # into the next slot

    def keep(self, new: dict[str, bytes]) -> None:
        """One file of this partition's answers, written aside and renamed: a reader sees all of it or none, and a task that fails before leaves nothing."""
        if not new:
            return
        store, path = self.place("store")
        store.create_dir(path)
        name = uuid.uuid4().hex
        table = pa.table({"key": pa.array(list(new), pa.string()), "body": pa.array(list(new.values()), pa.binary())})
        with store.open_output_stream(f"{path}/_{name}") as out:  # hidden from readers
            pq.write_table(table, out)
        store.move(f"{path}/_{name}", f"{path}/part-{name}.parquet")

    def batches(self, bodies: list[tuple[str, bytes | None]]) -> Iterator[pa.RecordBatch]:
        good = [(i, b if b is not None and survey.MARKER.encode() not in b[: survey.WITHIN] else None) for i, b in bodies]
        if self.kind == "records":
            rows = [(i, r) for i, b in good if b is not None for r in records.of_layer(b, self.options["layer"])]
            value = lambda x: x if isinstance(x, str) else None
            columns = [pa.array([i for i, _ in rows], pa.string()), *(pa.array([value(r.get(f)) for _, r in rows], pa.string()) for f in records.FIELDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *records.FIELDS.values()])
            return
        held, size = [], 0
        for i, b in good:
            held.append((i, *imagery.shape_and_pixels(b, self.kind)))
            size += 0 if held[-1][3] is None else held[-1][3].nbytes
            if size >= BATCH_BYTES:
                yield imagery.pixel_batch(held)
                held, size = [], 0
        yield imagery.pixel_batch(held)


class MapService(DataSource):
    """Options: requests (a Parquet table of id, params as JSON), store (a folder of kept answers), kind (records, images, heights), transport ("module:name" of a function of these options that returns a ``Transport``), per_second (2; 0 for no limit), slots (8: partitions under a limit, no more than the cluster runs at once), layer (of records).

    Each id gives the rows of its answer: the records, or one row of pixels (null where there are none). Answers are
    kept in the same form as by ``service.fetched``, so either path finds what the other has asked. Paths are local, or
    in a store that pyarrow opens. Equal requests are made once for each EACH rows at most.
    """

    @classmethod
    def name(cls) -> str:
        return "map_service"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema: StructType) -> MapReader:
        return MapReader(self.options)
