"""Ordered folds per key: caches, rate limits, token families, upload replay, disk health.

Each fold takes the rows of one key in order. A key's rows are read by one task as a stream of batches, never as one
group in memory: rows are dealt by key and sorted, and the fold's state passes from batch to batch.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """A row out for each row in: step(state, row) returns the new columns of `schema`; they follow the row's own."""
    out = StructType([*df.schema.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                key = tuple(r[k] for k in keys)
                if state is None or key != now:
                    now, state = key, start()
                r |= step(state, r)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, out)


class Lru:
    """A byte-budget cache: items over the budget are ignored, a hit is the newest again, the oldest go until the rest fits."""

    def __init__(self, budget: int):
        self.budget, self.used, self.items = budget, 0, OrderedDict()

    def __contains__(self, key) -> bool:
        return key in self.items

    def get(self, key) -> bool:
        if key in self.items:
            self.items.move_to_end(key)
            return True
        return False

    def put(self, key, size: int) -> None:
        if size > self.budget:
            return
        self.used -= self.items.pop(key, 0)
        self.items[key] = size
        self.used += size
        while self.used > self.budget:
            self.used -= self.items.popitem(last=False)[1]


def lru(df: DataFrame, keys: list[str], order: list[str], item: str, size: str, budget: int) -> DataFrame:
    """df with hit: whether the item was cached; misses load it."""

    def step(cache: Lru, r: dict) -> dict:
        hit = cache.get(r[item])
        if not hit:
            cache.put(r[item], r[size])
        return {"hit": hit, "used": cache.used}

    return fold(df, keys, order, lambda: Lru(budget), step, "hit boolean, used long")


def lru_prefetch(df: DataFrame, keys: list[str], order: list[str], position: str, size: Callable[[int], int], budget: int, page: int, most: int) -> DataFrame:
    """As lru over positions 0..most-1 of size(position) bytes each. A miss loads the item and then those of the half page
    that begins with it which aren't cached; looking for them doesn't make them newer. `loads` counts items read."""

    def step(cache: Lru, r: dict) -> dict:
        at = r[position]
        hit, loads = cache.get(at), 0
        if not hit:
            for i in [at, *(j for j in range(at + 1, min(most, at + page // 2)))]:
                if i == at or i not in cache:
                    cache.put(i, size(i))
                    loads += 1
        return {"hit": hit, "loads": loads}

    return fold(df, keys, order, lambda: Lru(budget), step, "hit boolean, loads int")


def rate_limit(df: DataFrame, keys: list[str], ts: str, tie: str, limit: int = 5, window: float = 60.0) -> DataFrame:
    """df with admitted: fewer than `limit` admitted attempts in the last `window`; attempts that are refused don't count."""

    def step(held: deque, r: dict) -> dict:
        while held and r[ts] - held[0] > window:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(r[ts])
        return {"admitted": ok}

    return fold(df, keys, [ts, tie], deque, step, "admitted boolean")


def token_bucket(df: DataFrame, keys: list[str], ts: str, tie: str, amount: str, rate: float, burst: float) -> DataFrame:
    """df with delay: seconds to wait before the amount is through; the level may fall below 0; rate <= 0 is off."""

    def step(s: dict, r: dict) -> dict:
        if rate <= 0:
            return {"delay": 0.0}
        if "at" not in s:
            s |= {"at": r[ts], "level": burst}
        s["level"] = min(burst, s["level"] + (r[ts] - s["at"]) * rate) - r[amount]
        s["at"] = r[ts]
        return {"delay": max(0.0, -s["level"] / rate)}

    return fold(df, keys, [ts, tie], dict, step, "delay double")


def token_families(df: DataFrame, order: list[str], ts: str | None = None, ttl: float = float("inf")) -> DataFrame:
    """Rows (family, token, event): 'issue', 'use' (rotates: the token is revoked), 'revoke_all'; outcome is issued, rotated,
    reuse, revoked or refused.

    Using a revoked token revokes its whole family. A token that was never issued, or was issued more than ttl seconds
    before (by the column ts), is refused and leaves the family alone. A revoked family issues no more.
    """

    def step(s: dict, r: dict) -> dict:
        held, event = s.setdefault("held", {}), r["event"]  # token -> [issued at, still good]
        now = r[ts] if ts else 0.0
        if event == "issue":
            if s.get("dead"):
                return {"outcome": "refused"}
            held[r["token"]] = [now, True]
            return {"outcome": "issued"}
        if event == "revoke_all":
            s["dead"] = True
            return {"outcome": "revoked"}
        own = held.get(r["token"])
        if own is None or now - own[0] > ttl:
            return {"outcome": "refused"}
        if s.get("dead") or not own[1]:
            s["dead"] = True
            return {"outcome": "reuse"}
        own[1] = False
        return {"outcome": "rotated"}

    return fold(df, ["family"], order, dict, step, "outcome string")


def upload_replay(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows (upload, event, size, offset, length, ok): the status each request of a resumable upload gets, and the offset after it.

    create 201; patch 204, 409 at a wrong offset, 413 past the size; the patch that completes verifies the digest (ok): 460 deletes
    the upload; a completed upload answers 204; head 200; terminate 204; anything on an unknown upload 404.
    """

    def step(s: dict, r: dict) -> dict:
        event = r["event"]
        if event == "create":
            s |= {"size": r["size"], "at": 0, "on": True, "done": False}
            return {"status": 201, "at": 0}
        if not s.get("on"):
            return {"status": 404, "at": None}
        if event == "head":
            return {"status": 200, "at": s["at"]}
        if event == "terminate":
            s["on"] = False
            return {"status": 204, "at": None}
        if s["done"]:
            return {"status": 204, "at": s["at"]}
        if r["offset"] != s["at"]:
            return {"status": 409, "at": s["at"]}
        if s["at"] + r["length"] > s["size"]:
            return {"status": 413, "at": s["at"]}
        s["at"] += r["length"]
        if s["at"] == s["size"]:
            s["done"], s["on"] = True, bool(r["ok"])
            return {"status": 204 if r["ok"] else 460, "at": s["at"] if r["ok"] else None}
        return {"status": 204, "at": s["at"]}

    return fold(df, ["upload"], order, dict, step, "status int, at long")


def disk_health(df: DataFrame, order: list[str], threshold: int = 10) -> DataFrame:
    """Rows (disk_id, event) with the status and the error count after each event.

    'error' counts and degrades an online disk from the threshold on; the count is never reset, so the next error after a
    recovery degrades again. 'probe_bad' fails a disk, 'probe_ok' brings a failed one back online; 'smart_fail' is a good
    probe whose SMART check fails: it degrades an online disk. 'retire' ends a disk's transitions.
    """

    def step(s: dict, r: dict) -> dict:
        now, event = s.get("status", "online"), r["event"]
        n = s.get("errors", 0) + (event == "error")
        if event == "retire" or now == "retired":
            now = "retired"
        elif event == "error":
            now = "degraded" if now == "online" and n >= threshold else now
        elif event == "probe_bad":
            now = "failed"
        elif event in ("probe_ok", "smart_fail"):
            now = "online" if now == "failed" else "degraded" if now == "online" and event == "smart_fail" else now
        s |= {"status": now, "errors": n}
        return {"status": now, "errors": n}

    return fold(df, ["disk_id"], order, dict, step, "status string, errors int")


def job_states(df: DataFrame, order: list[str], most: int = 5) -> DataFrame:
    """Rows (job, event): 'start', 'ok', 'error', 'restart'; state after each, with the attempts made."""

    def step(s: dict, r: dict) -> dict:
        state, n = s.get("state", "queued"), s.get("n", 0)
        if r["event"] == "start" and state == "queued":
            state, n = "running", n + 1
        elif state == "running":
            state = {"ok": "done", "error": "failed" if n >= most else "queued", "restart": "queued"}.get(r["event"], state)
        s |= {"state": state, "n": n}
        return {"state": state, "attempts": n}

    return fold(df, ["job"], order, dict, step, "state string, attempts int")


#: Fixed values of the picture grid: wanted height of a row and gap between pictures, in pixels.
ROW_HEIGHT, GAP = 200.0, 4.0


def justified_rows(df: DataFrame, keys: list[str], order: list[str], width: str, height: str, target: float, most: float = ROW_HEIGHT, gap: float = GAP) -> DataFrame:
    """df with row and aspect: pictures (aspect clamped to [0.4, 3], 1 if unknown) fill a row of `target` pixels, less the
    gaps between them, until it is no higher than `most`."""

    def step(s: dict, r: dict) -> dict:
        aspect = min(3.0, max(0.4, r[width] / r[height])) if r[width] and r[height] else 1.0
        row, n = s.get("row", 0), s.get("n", 0) + 1
        total = s.get("sum", 0.0) + aspect
        full = (target - gap * (n - 1)) / total <= most
        s |= {"row": row + full, "n": 0 if full else n, "sum": 0.0 if full else total}
        return {"row": row, "aspect": aspect}

    return fold(df, keys, order, dict, step, "row int, aspect double")


def row_heights(rows: DataFrame, keys: list[str], target: float, most: float = ROW_HEIGHT, gap: float = GAP) -> DataFrame:
    """(keys, row, pictures, height) of justified_rows(): full rows span the target, the last one is `most` high at most."""
    own = rows.groupBy(*keys, "row").agg(F.count("*").alias("pictures"), F.sum("aspect").alias("sum"))
    height = F.least(F.lit(most), (target - gap * (F.col("pictures") - 1)) / F.col("sum"))
    return own.select(*keys, "row", "pictures", height.alias("height"))


def hit_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("requests"), F.count_if(F.col("hit")).alias("hits"))
