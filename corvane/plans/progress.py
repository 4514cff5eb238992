"""Runs over a store in committed batches: buckets that belong together, one group after another.

Tables with the same key are in buckets that correspond, so a batch takes the rows of some
buckets from all of them, changes those buckets, and commits; what breaks off later
leaves it done.  Batches in which nothing is pending any more are remembered by the folders
of their buckets: as long as no one has written there, later runs don't read them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from corvane.operators.stats import throughput
from corvane.operators.store import State, Store

#: Megabytes of a batch, of all its tables together.
BATCH_MB = 1024
Group = tuple[int, set[int]]
Progress = Callable[[dict], None]


@dataclass
class Seen:
    """What a run knows: of the groups (bucket numbers modulo n) without pending rows the folders, by table, and a note of its result."""

    store: Store
    name: str
    n: int = 0
    groups: dict[str, list[str]] = field(default_factory=dict)
    note: dict = field(default_factory=dict)

    @property
    def path(self) -> str:
        return f"{self.store.root}/_seen/{self.name}.json"

    def load(self) -> Seen:
        fs, file = self.store._fs(self.path)
        if fs.exists(file):
            stream = fs.open(file)
            raw = self.store._jvm.java.lang.String(self.store._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, fs.getFileStatus(file).getLen()), "UTF-8")
            stream.close()
            try:
                told = json.loads(str(raw))
            except ValueError:  # its writer died: nothing is known
                return self
            self.n, self.groups, self.note = told["n"], told["groups"], told["note"]
        return self

    def save(self) -> None:
        fs, file = self.store._fs(self.path)
        out = fs.create(file, True)
        out.write(bytearray(json.dumps({"n": self.n, "groups": self.groups, "note": self.note}).encode()))
        out.close()


def _folders(states: dict[str, State], n: int, g: int) -> list[str]:
    """The folders of a group, which change with every write to it."""
    return sorted(f"{t}/{s.buckets}/{f}" for t, s in states.items() for b, f in s.folders.items() if b % n == g)


def _batches(states: dict[str, State], n: int, left: list[int], megabytes: float) -> list[tuple[set[int], float]]:
    """Groups put together up to some megabytes, with their megabytes."""
    out: list[tuple[set[int], float]] = []
    for g in left:
        mb = sum(s.sizes.get(b, 0) for s in states.values() for b in s.folders if b % n == g) / 2**20
        if out and out[-1][1] + mb <= megabytes:
            out[-1][0].add(g)
            out[-1] = (out[-1][0], out[-1][1] + mb)
        else:
            out.append(({g}, mb))
    return out


def _alone(store: Store, before: dict[str, State], after: dict[str, State], commits: dict[str, int]) -> bool:
    """Whether all versions since `before` are this object's own."""
    return all(after[t].number - before[t].number == store.commits.get(t, 0) - commits.get(t, 0) for t in before)


@contextmanager
def unaffected(store: Store, name: str | None, tables: tuple[str, ...]) -> Iterator[None]:
    """What is written inside gives the run `name` nothing to do: its finished batches stay so, unless another writer wrote too."""
    if name is None:
        yield
        return
    before, commits, seen = {t: store.state(t) for t in tables}, dict(store.commits), Seen(store, name).load()
    done = [g for g, folders in seen.groups.items() if folders == _folders(before, seen.n, int(g))]
    yield
    after = {t: store.state(t) for t in tables}
    if done and _alone(store, before, after, commits) and seen.n == min(s.buckets for s in after.values()):
        seen.groups |= {g: _folders(after, seen.n, int(g)) for g in done}
        seen.save()


def in_batches(store: Store, tables: tuple[str, ...], work: Callable[[Group], dict[str, int]], *, name: str | None = None, megabytes: float = BATCH_MB, progress: Progress | None = None) -> dict[str, int]:
    """Calls work(group) for the tables' groups in batches and adds up the counts that it returns.

    name: batches without pending rows are remembered under it, and left out by later runs
    until they are written again; work's counts then must name rows that stay pending as
    errors or left.  Inside work the tables are read aligned, so it must be done with their frames when it returns.  progress is called after each batch with the counts so far, the batches done and left, rows a second and seconds left.
    """
    began, done_mb, total = time.time(), 0.0, {}
    states = {t: store.state(t) for t in tables}
    n = min(s.buckets for s in states.values())
    seen = Seen(store, name).load() if name else None
    if seen and seen.n != n:
        seen.n, seen.groups = n, {}
    left = [g for g in range(n) if not seen or seen.groups.get(str(g)) != _folders(states, n, g)]
    batches = _batches(states, n, left, megabytes)
    for k, (groups, mb) in enumerate(batches):
        before, commits = {t: store.state(t) for t in tables}, dict(store.commits)
        with store.aligned():
            counts = work((n, groups))
        for c, x in counts.items():
            total[c] = total.get(c, 0) + x
        after = {t: store.state(t) for t in tables}
        if seen and _alone(store, before, after, commits) and not counts.get("errors") and not counts.get("left") and n == min(s.buckets for s in after.values()):
            seen.groups |= {str(g): _folders(after, n, g) for g in groups}
            seen.save()
        done_mb += mb
        if progress:
            seconds, left_mb = time.time() - began, sum(b[1] for b in batches[k + 1 :])
            rows = total.get("processed", sum(x for c, x in total.items() if c not in ("errors", "left")))
            progress(total | throughput(rows, seconds) | {"batch": k + 1, "batches": len(batches), "eta_seconds": seconds * left_mb / done_mb if done_mb else 0.0})
    return total
