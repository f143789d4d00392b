"""A Python data source of HTTP responses, with a client that can be replaced.

``spark.read.format("responses").option("client", "package.module:factory").load(path)`` runs one client per
partition of seeds. Seeds are Parquet files under a path, also by platform, or JSON lines in the option ``seeds``; results
are rows, refusals too: nothing is raised for a bad address. Platforms choose files; as a stream, the source reads
files as they arrive and goes on from its last offset. Tests use a recorded client; no network is opened unless a client does it.
Planning lists the path with pyarrow, so it must be one that pyarrow opens; ``fetch_table`` takes seeds that Spark reads from anywhere.
"""

from __future__ import annotations

import gzip
import importlib
import ipaddress
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import Protocol
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from siltstone.functions import urls
from siltstone.shipping import ship

SCHEMA = (
    "seed_id long, url string, final_url string, status int, content_type string, headers map<string,array<string>>, body binary, bytes long, "
    "truncated boolean, redirects array<struct<url: string, status: int>>, rejected boolean, reject_code string"
)
MAX_BODY, MAX_HOPS = 5 * 1024 * 1024, 5


class Client(Protocol):
    """One request: status, headers and body. A client raises only for transport errors."""

    def get(self, url: str) -> tuple[int, dict[str, list[str]], bytes]: ...


class Recorded:
    """A client that answers from a dict: url -> (status, headers, body)."""

    def __init__(self, answers: dict[str, tuple[int, dict[str, list[str]], bytes]]) -> None:
        self.answers = answers

    def get(self, url: str) -> tuple[int, dict[str, list[str]], bytes]:
        if url not in self.answers:
            raise ConnectionError(url)
        return self.answers[url]


def first(headers: dict[str, list[str]], name: str) -> str:
    return next((v[0] for k, v in headers.items() if k.lower() == name and v), "")


def inflate(body: bytes, encoding: str) -> tuple[bytes, str | None]:
    """Body without its content encoding, and an error code. A broken end keeps what came before it."""
    name = encoding.split(",")[0].strip().lower()
    if name in ("", "identity"):
        return body, None
    if name not in ("gzip", "x-gzip", "deflate"):
        return b"", "unsupported_encoding"
    unpack = zlib.decompressobj(31 if "gzip" in name else 15)
    try:
        return unpack.decompress(body) + unpack.flush(), None
    except zlib.error:
        try:
            with gzip.GzipFile(fileobj=__import__("io").BytesIO(body)) as f:
                return f.read1(MAX_BODY), "body_read_error"
        except (OSError, EOFError, zlib.error):
            return b"", "body_read_error"


NETWORKS = [ipaddress.ip_network(block) for block in (*urls.PRIVATE_V4, *urls.PRIVATE_V6)]


def guarded(url: str) -> str | None:
    """Why an address may not be asked for: its scheme, credentials, port or a private host; null if it may.

    Names are resolved by the client, which must check what they resolve to with ``is_public`` as well.
    """
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "invalid_url"
    if parts.scheme not in ("http", "https"):
        return "unsupported_scheme"
    if parts.username is not None or parts.password is not None:
        return "userinfo_url"
    if not host:
        return "invalid_url"
    if port in urls.BLOCKED_PORTS:
        return "blocked_port"
    name = dotted(host.rstrip(".").lower())
    return None if name != "localhost" and not name.endswith(".localhost") and is_public(name) else "private_address"


def dotted(host: str) -> str:
    """A host of 1 to 4 numbers in any base as clients read it; other hosts as they are."""
    parts = host.split(".")
    if len(parts) > 4 or not all(re.fullmatch(r"0x[0-9a-f]*|[0-9]+", p) for p in parts):
        return host
    try:
        *front, last = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8 if p.startswith("0") else 10) for p in parts]
        value = sum(n << (24 - 8 * k) for k, n in enumerate(front)) + last
        return str(ipaddress.IPv4Address(value)) if all(n < 256 for n in front) and last < 256 ** (4 - len(front)) else host
    except ValueError:
        return host


def is_public(address: str) -> bool:
    """Whether an address literal lies in no private or reserved range; true for names."""
    try:
        literal = ipaddress.ip_address(address)
    except ValueError:
        return True
    return not any(literal.version == n.version and literal in n for n in NETWORKS)


def fetch(client: Client, seed_id: int, url: str, max_body: int = MAX_BODY, max_hops: int = MAX_HOPS) -> tuple:
    """One seed as a row: every hop is guarded, redirects are followed up to a limit, an https page never leads to an http one."""
    hops: list[tuple[str, int]] = []
    at = url

    def refused(code: str) -> tuple:
        return (seed_id, url, at, 0, None, {}, b"", 0, False, hops, True, code)

    while True:
        if code := guarded(at):
            return refused(code)
        try:
            status, headers, body = client.get(at)
        except TimeoutError:
            return refused("timeout")
        except OSError:
            return refused("network_error")
        location = first(headers, "location")
        if not (300 <= status < 400 and location):
            break
        hops.append((at, status))
        if len(hops) > max_hops:
            return refused("redirect_limit")
        following = urljoin(at, location)
        if at.lower().startswith("https:") and following.lower().startswith("http:"):
            return refused("scheme_downgrade")
        at = following
    plain, error = inflate(body, first(headers, "content-encoding"))
    if error and not plain:
        return refused(error)
    cut = len(plain) > max_body
    return (seed_id, url, at, status, first(headers, "content-type") or None, headers, plain[:max_body], min(len(plain), max_body), cut or error is not None, hops, False, None)


class Seeds:
    """A folder of Parquet files of seeds (seed_id, url), as Spark writes them, also in folders ``platform=...``.

    Only names and row counts are read for planning; executors read the seeds.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def files(self) -> list[str]:
        """Files in order of their names, which for a stream must ascend as files arrive."""
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = [f.path[len(root.rstrip("/")) + 1 :] for f in found if f.is_file and f.path.endswith(".parquet")]
        return sorted((n for n in names if not any(part.startswith(("_", ".")) for part in n.split("/"))), key=lambda n: n.rsplit("/", 1)[-1])

    def open(self, name: str) -> pq.ParquetFile:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return pq.ParquetFile(system.open_input_file(f"{root.rstrip('/')}/{name}"))

    @staticmethod
    def platform(name: str) -> str | None:
        found = re.search(r"(?:^|/)platform=([^/]*)/", name)
        return unquote(found[1]) if found and found[1] != "__HIVE_DEFAULT_PARTITION__" else None


class _Part(InputPartition):
    """Row groups of one file of seeds, or seeds themselves where they came as an option."""

    def __init__(self, seeds: list[tuple[int, str]] | None = None, path: str = "", name: str = "", groups: tuple[int, ...] = ()) -> None:
        super().__init__(name)
        self.seeds, self.path, self.name, self.groups = seeds, path, name, groups


def _answered(factory: str, partition: _Part) -> Iterator[tuple]:
    module, _, name = factory.partition(":")
    client = getattr(importlib.import_module(module), name)()
    if partition.seeds is not None:
        for seed_id, url in partition.seeds:
            yield (*fetch(client, seed_id, url), None)
        return
    file, platform = Seeds(partition.path).open(partition.name), Seeds.platform(partition.name)
    for group in partition.groups:
        for batch in file.iter_batches(batch_size=1024, row_groups=[group], columns=["seed_id", "url"]):
            for seed_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield (*fetch(client, seed_id, url or ""), platform)


class _Reader(DataSourceReader):
    """Reads all seeds, or those of some platforms, whose files alone are planned.

    The option ``platforms`` (JSON array) names them. With ``pushdown=true`` equalities on ``platform`` do so, too; Spark 4.1 keeps what was pushed
    for later queries of the same DataFrame that have no filter, so this is for a DataFrame that one query uses.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.factory, self.path = options["client"], options.get("path")
        self.seeds = [(int(s["seed_id"]), s["url"]) for s in map(json.loads, options.get("seeds", "").splitlines()) if s]
        self.parts = max(1, int(options.get("partitions", "4")))
        self.platforms: set[str | None] | None = set(json.loads(options["platforms"])) if "platforms" in options else None
        self.pushes = options.get("pushdown", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if self.pushes and self.path and wanted is not None and f.attribute == ("platform",):
                self.platforms = wanted if self.platforms is None else self.platforms & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if not self.path:
            return [_Part(self.seeds[k :: self.parts]) for k in range(min(self.parts, max(1, len(self.seeds))))]
        return planned(self.path, [n for n in Seeds(self.path).files() if self.platforms is None or Seeds.platform(n) in self.platforms])

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _answered(self.factory, partition)


def planned(path: str, names: list[str], groups: int = 1) -> list[InputPartition]:
    """A partition for every ``groups`` row groups of each file."""
    seeds, out = Seeds(path), []
    for name in names:
        n = seeds.open(name).num_row_groups
        out += [_Part(path=path, name=name, groups=tuple(range(k, min(n, k + groups)))) for k in range(0, n, groups)]
    return out or [_Part([])]


class _StreamReader(DataSourceStreamReader):
    """Reads files of seeds as they arrive; the offset is the name of the last file that was read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.factory, self.path = options["client"], options["path"]
        self.most = int(options.get("maxFilesPerTrigger", "1000"))
        self.at: str | None = None

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        after = [n for n in map(_base, Seeds(self.path).files()) if n > (self.at or "")][: self.most]
        self.at = after[-1] if after else self.at or ""
        return {"file": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at or "", end["file"])
        return planned(self.path, [n for n in Seeds(self.path).files() if start["file"] < _base(n) <= end["file"]])

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _answered(self.factory, partition)


def _base(name: str) -> str:
    return name.rsplit("/", 1)[-1]


class Responses(DataSource):
    """The data source ``responses``: option ``client``, and ``path`` (a folder of seeds) or ``seeds`` (JSON lines)."""

    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return f"{SCHEMA}, platform string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known; filters are offered to Python sources only if the session says so."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)


def fetch_table(seeds: DataFrame, factory, per_partition: int = 64) -> DataFrame:
    """Responses of a table of seeds (seed_id, url) of any size: one client per task, rows streamed.

    ``factory`` makes a client on the executor.
    """

    def run(batches):
        import pandas as pd

        client = factory()
        names = [f.split()[0] for f in SCHEMA.replace("map<string,array<string>>", "map").replace("array<struct<url: string, status: int>>", "array").split(", ")]
        for pdf in batches:
            rows = [fetch(client, int(s), u) for s, u in zip(pdf["seed_id"], pdf["url"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            out["redirects"] = [[{"url": u, "status": s} for u, s in r] for r in out["redirects"]]
            yield out

    return seeds.select("seed_id", "url").mapInPandas(run, SCHEMA)


def offline() -> Client:
    """A client that knows no address."""
    return Recorded({})
