"""URL rules by a sorted digest array.

The rules' strings (host, path) are hashed with 64-bit xxhash; a file of the
sorted keys, with the full strings behind them, is handed to every executor and
memory-mapped there.  A url's candidate strings are its host and the host's
parents, each with those beginnings of its path whose length occurs among the
rules; a vectorised binary search finds their keys, the stored string confirms a
hit, and the longest rule wins.  A url that no rule fits is not listed, and so
gets the default verdict.

Defined cases: a null url, or one without ``://``, has empty host and path, and
can fit only a rule without host; ties in length go to the longer host; rules
given twice count once, blocking before allowing; repeated rows are judged alike;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import LOWER

ALLOW, BLOCK = "allow", "block"


def write_digests(rules: list[tuple[str, str, str]], path: str) -> None:
    """Rules (verdict, host, path) as one file: count, sorted keys, places of the strings, strings."""
    own = {}
    for verdict, host, start in sorted(rules):
        own[(host.encode().translate(LOWER), start.encode())] = verdict
    rows = sorted((xxhash.xxh64_intdigest(h + b"\0" + p), h, p, v) for (h, p), v in own.items())
    strings = [h + b"\0" + p + b"\0" + v.encode() for _, h, p, v in rows]
    with open(path, "wb") as f:
        f.write(np.array([len(rows)], dtype="<u8").tobytes())
        f.write(np.array([r[0] for r in rows], dtype="<u8").tobytes())
        f.write(np.cumsum([0, *map(len, strings)]).astype("<u8").tobytes())
        f.write(b"".join(strings))


class DigestArray:
    """The file of write_digests, memory-mapped."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view("<u8")[0])
        self.keys = raw[8 : 8 + 8 * n].view("<u8")
        self.places = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.strings = raw[16 + 16 * n :]

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The first place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == keys, at, -1)

    def confirm(self, at: int, key: int, host: bytes, path: bytes) -> str | None:
        """The verdict of the stored string that equals the candidate, among those of equal key."""
        while at < len(self.keys) and self.keys[at] == key:
            h, p, v = self.strings[int(self.places[at]) : int(self.places[at + 1])].tobytes().split(b"\0")
            if (h, p) == (host, path):
                return v.decode()
            at += 1
        return None


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.encode().translate(LOWER).decode(), slash + path


def _judge(name: str, lengths: list[int], default: str) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths, owner, candidates = [], [], [], []
            for i, url in enumerate(batch.column(1).to_pylist()):
                host, path = split_url(url)
                hosts.append(host)
                paths.append(path)
                h, p = host.encode(), path.encode()
                starts = [p[:n] for n in lengths if n <= len(p)]
                while True:
                    candidates += [(h, s) for s in starts]
                    owner += [i] * len(starts)
                    if b"." not in h:
                        break
                    h = h.partition(b".")[2]
            keys = np.fromiter((xxhash.xxh64_intdigest(h + b"\0" + p) for h, p in candidates), np.uint64, len(candidates))
            at = digests.probe(keys)
            best: dict[int, tuple] = {}
            for k in np.flatnonzero(at >= 0).tolist():
                h, p = candidates[k]
                if (verdict := digests.confirm(int(at[k]), keys[k], h, p)) is not None:
                    best[owner[k]] = max(best.get(owner[k], ((-1, -1), b"", "")), ((len(h) + len(p), len(h)), h + p, verdict))
            rules = [best[i][1].decode() if i in best else None for i in range(len(hosts))]
            verdicts = [best[i][2] if i in best else default for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return judge


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    spark = pages.sparkSession
    with tempfile.TemporaryDirectory() as folder:
        write_digests(rules, made := os.path.join(folder, "made"))
        with open(made, "rb") as f:
            name = f"tidewire-digests-{hashlib.sha256(f.read()).hexdigest()[:24]}"
    # Spark's file server hands the file to the executors; it has to stay as long as the session does
    kept = os.path.join(tempfile.gettempdir(), name)
    write_digests(rules, kept)
    spark.sparkContext.addFile(kept)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = own.schema["page_id"].dataType.simpleString()
    lengths = sorted({len(p.encode()) for _, _, p in rules})
    return own.mapInArrow(_judge(name, lengths, default), f"page_id {kind}, host string, path string, rule string, verdict string")
