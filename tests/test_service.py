"""The map service without network: records, one rate for all tasks, kept answers, the data source."""

import json
import os
import random
import threading
import time

import numpy as np
import pytest

from farpoint.operators import catalog
from farpoint.sources import imagery, mapsource, records, service, survey
from tests.test_chips import png, tiff


def text_of(value, indent=0):
    """A nested value as a service would write it, with several styles."""
    pad, out = " " * indent, ""
    if isinstance(value, dict):
        for i, (k, v) in enumerate(value.items()):
            if isinstance(v, (dict, list)) and v:
                out += f"{pad}{k}:\n{text_of(v, indent + (0 if isinstance(v, list) and i % 2 else 2))}"
            else:
                out += f"{pad}{k}: {one_line(v)}\n"
        return out
    for v in value:
        inner = text_of(v, indent + 2) if isinstance(v, (dict, list)) and v else f"{pad}  {one_line(v)}\n"
        out += f"{pad}- {inner[indent + 2 :]}"
    return out


def one_line(v):
    if v is None:
        return "~"
    if v in ([], {}):
        return str(v)
    return json.dumps(v) if v != v.strip() or any(c in v for c in ":#'\n\"[") or not v else v


def test_documents_come_back():
    rng = random.Random(4)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return rng.choice([None, "a", "1.5", "it's", "x: y", " pad ", "#no", "http://a/b:c", "two words", "", [], {}])
        return {f"k{i}": made(depth - 1) for i in range(rng.randint(1, 4))} if kind < 0.7 else [made(depth - 1) for _ in range(rng.randint(1, 4))]

    for _ in range(2000):
        value = {"layer": made(4), "more": made(3)}
        assert records.parsed("---\n" + text_of(value).replace("\n", "  # remark\n\n", 1)) == value


@pytest.mark.parametrize("text", ["a: 1\n  b: 2", "a:\n  - 1\n  b: 2", "a: 'x", "\ta: 1", "a: &x 1", "a: [1, 2]", "a:\n    b: 1\n  c: 2", "- a\nb: 1", "a: b: c", 'a: "\\q"', "a: 1\n---\nb: 2", "a: |\n  x"])
def test_malformed_documents(text):
    with pytest.raises(ValueError):
        records.parsed(text)
    assert records.of_layer(text.encode(), "a") == []


def test_request_keys(spark):
    params = [{"b": "x y&z", "a": "ä*~_.-", "LAYERS": "1,2;3"}, {"n": "5"}, {}]
    got = [r[0] for r in spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(params)] + [(9, None)], "i int, p string").orderBy("i").select(service.key_of(service.F.col("p"))).collect()]
    assert got == [*map(service.request_key, params), None]


class Clock:
    """Time for several threads that only passes while all of them wait."""

    def __init__(self, n):
        self.lock, self.time, self.until, self.n = threading.Condition(), 0.0, {}, n

    def now(self):
        return self.time

    def sleep(self, s):
        me = threading.get_ident()
        with self.lock:
            self.until[me] = self.time + s
            self.turn()
            self.lock.wait_for(lambda: self.time >= self.until[me])
            del self.until[me]

    def out(self, by=-1):
        with self.lock:
            self.n += by
            self.turn()

    def turn(self):
        if len(self.until) >= self.n and self.until:
            self.time = max(self.time, min(self.until.values()))
            self.lock.notify_all()


@pytest.mark.parametrize("loads", [[9, 9, 9, 9], [40, 0, 0, 0], [1, 30, 2, 5]])
def test_one_rate_for_all_tasks(loads):
    """Attempts of four tasks on a common clock, a third of which fail at first: never more than the rate, and no slots lost where tasks are done."""
    clock, made, lock, barrier, told = Clock(4), [], threading.Lock(), threading.Barrier(4), [None] * 4

    def task(me):
        def gather(message):
            told[me] = message
            clock.out(-1)
            barrier.wait()
            seen = list(told)
            barrier.wait()
            clock.out(1)
            barrier.wait()
            return seen

        failed = set()

        def transport(params):
            with lock:
                made.append(clock.now())
            if params["i"] % 3 == 0 and params["i"] not in failed:
                failed.add(params["i"])
                raise OSError
            return b"x"

        queue = service.Queue([(f"{me}-{i}", {"i": i}) for i in range(loads[me])], transport)
        out[me] = list(service.paced(queue, me, gather, 2.0, clock.now, clock.sleep))

    out = {}
    threads = [threading.Thread(target=task, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert sorted(k for o in out.values() for k, _ in o) == sorted(f"{m}-{i}" for m, n in enumerate(loads) for i in range(n))
    retries = sum(-(-n // 3) for n in loads)
    assert len(made) == sum(loads) + retries
    made.sort()
    for i, t in enumerate(made):  # in no second more than two, with the one that begins it
        assert sum(t <= x < t + 1 - 1e-9 for x in made[i:]) <= 2
    assert made[-1] <= len(made) / 2 + 12


def test_rate_of_a_job(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def transport(params):
        n = len([f for f in os.listdir(log) if f.startswith(f"{params['i']}-")])
        (log / f"{params['i']}-{n}-{time.time()}").touch()
        if params["i"] == "3" and n == 0:
            raise OSError
        return params["i"].encode()

    asked = spark.createDataFrame([(i, json.dumps({"i": str(i)})) for i in range(30)], "i int, params string")
    got = service.fetched(asked, transport, str(tmp_path / "store"), per_second=10.0, partitions=4)
    assert {r["i"]: r["body"] for r in got.collect()} == {i: str(i).encode() for i in range(30)}
    times = sorted(float(f.rsplit("-", 1)[1]) for f in os.listdir(log))
    assert len(times) == 31 and times[-1] - times[0] >= 2.5 and all(sum(t <= x < t + 1 for x in times) <= 12 for t in times)


def test_equal_requests_are_made_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def transport(params):
        (log / f"{os.getpid()}-{len(os.listdir(log))}").touch()
        return params["a"].encode()

    asked = spark.createDataFrame([(i, json.dumps({"a": str(i % 2)})) for i in range(6)] + [(9, None)], "i long, params string")
    for _ in range(2):
        got = {r["i"]: r["body"] for r in service.fetched(asked, transport, str(tmp_path / "store"), per_second=0, partitions=1, each=1).collect()}
        assert got == {**{i: str(i % 2).encode() for i in range(6)}, 9: None}
    assert len(os.listdir(log)) == 2


def body_of(lon):
    return f"""other: ~
nac:
  - product_id: " M{lon:.0f} "
    resolution: 1.5
    center_longitude: 190
    center_latitude: x
    incidence_angle: 60.5
  - product_id: M2
    resolution: 1
    center_longitude: 190
    center_latitude: 3
  - resolution: 1
""".encode()


def test_survey(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def transport(params):
        (log / str(time.time_ns())).touch()
        lon = float(params["BBOX"].split(",")[0]) + 0.15
        if lon < 1:
            raise OSError("down")
        return b"<ServiceExceptionReport>" if lon < 11 else b"nac:\n - a\n  b: broken" if lon < 21 else body_of(lon)

    points = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0), (20.0, 0.0), (30.0, 7.0), (180.0, 0.0)], "lon double, lat double")
    tries, service.TRIES = service.TRIES, 1
    try:
        for n in (4, 5):  # only the point that failed is asked again
            got = survey.answers(points, transport, str(tmp_path / "store"), "nac", per_second=0, partitions=2)
            assert {r["lon"] for r in got.where("body is null").collect()} == {0.0, 180.0} and len(os.listdir(log)) == n
    finally:
        service.TRIES = tries
    rows = {r["product_id"]: r for r in catalog.clean_products(survey.products(got, "nac")).collect()}
    assert rows.keys() == {"M30", "M2"} and rows["M30"]["center_lat"] == 7.0 and rows["M2"]["center_lon"] == -170.0 and rows["M30"]["incidence_angle_deg"] == 60.5


def fake(options):
    """A transport for the data source: logs each request, and fails for ids from 90 on."""

    def transport(params):
        open(os.path.join(options["log"], f"{time.time_ns()}-{os.getpid()}"), "w").close()
        i = int(params["i"])
        if i >= 90:
            raise OSError
        if options["kind"] == "records":
            return body_of(i)
        z = np.arange(12.0).reshape(3, 4) + i
        return tiff(z) if options["kind"] == "heights" else png(z.astype(np.uint8)[..., None], 0)

    return transport


def test_map_service_source(spark, tmp_path):
    spark.dataSource.register(mapsource.MapService)
    asked = [(str(i), json.dumps({"i": str(i)})) for i in range(12)] + [("same", json.dumps({"i": "3"})), ("none", None)]
    spark.createDataFrame(asked, "id string, params string").repartition(3).write.parquet(f"{tmp_path}/requests")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def read(kind, **more):
        os.makedirs(f"{tmp_path}/{kind}-log", exist_ok=True)
        options = {"requests": f"{tmp_path}/requests", "store": f"{tmp_path}/{kind}", "kind": kind, "layer": "nac", "transport": "tests.test_service:fake", "log": f"{tmp_path}/{kind}-log", "per_second": "0"} | more
        return spark.read.format("map_service").options(**options).load()

    logged = lambda kind: len(os.listdir(f"{tmp_path}/{kind}-log"))
    few = read("heights").where("id in ('3', '5')").collect()
    assert {r["id"]: r["pixels"] for r in few} == {i: (np.arange(12.0) + int(i)).tolist() for i in ("3", "5")} and logged("heights") == 2  # the filter reached the requests
    for _ in range(2):
        whole = {r["id"]: r for r in read("heights").collect()}
        assert whole.keys() == {*map(str, range(12)), "same"} and (whole["7"]["h"], whole["7"]["w"]) == (3, 4) and logged("heights") <= 13
    before = logged("heights")
    read("heights").collect()
    assert logged("heights") == before and not [f for f in os.listdir(f"{tmp_path}/heights") if f.startswith("_")]
    # the other path finds what was kept, and the other way round
    body = service.fetched(spark.createDataFrame(asked[:3], "id string, params string"), lambda p: 1 / 0, f"{tmp_path}/heights", per_second=0).collect()
    assert all(imagery.tiff_pixels(bytes(r["body"]))[0, 0] == int(r["id"]) for r in body)
    assert read("images").where("id = '4'").first()["pixels"] == pytest.approx(((np.arange(12) + 4) / 255).tolist())
    rows = read("records", per_second="20").where("id in ('7', '8')").collect()
    assert sorted((r["id"], r["product_id"], r["center_lon"]) for r in rows if r["product_id"]) == [("7", " M7 ", "190"), ("7", "M2", "190"), ("8", " M8 ", "190"), ("8", "M2", "190")]
