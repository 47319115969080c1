"""Claims on pending work: markers that one of several workers gets and the others do not.

A result that is being made has a marker file beside it. Making a marker is one atomic step
of the file system: it is created only if it is not there, so of two workers that see the
same result pending one gets it. The marker says who holds it and until when; a holder that
lives renews it, and one that has died is taken over after that time, again by one worker
only. Whatever becomes of the work, its marker is removed, so that failed work is pending
again.

Everything goes through Spark's file systems: on a cluster, through the shared one. Creating
is atomic where that file system's is (HDFS and its like); local disks and mounts link a
finished file into place, as their file system here only looks first and creates then.
"""

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from packwright.operators.pending import RUNNING_SUFFIX, pending_results
from packwright.sources.records import list_files

# How long a claim holds without being renewed.
LEASE_SECONDS = 3600.0


@dataclass(frozen=True)
class Claim:
    """A marker held by ``owner``; ``path`` is that of the result."""

    path: str
    owner: str
    until: float

    @property
    def marker(self) -> str:
        return self.path + RUNNING_SUFFIX


@dataclass
class Outcome:
    """What a worker did: results made, those it failed at with the error, those others had."""

    made: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    taken: list[str] = field(default_factory=list)


class Claims:
    """The claims of one worker in the file system of ``folder``."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        owner: str | None = None,
        lease: float = LEASE_SECONDS,
        clock: Callable[[], float] = time.time,
    ):
        if lease <= 0:
            raise ValueError("a lease is longer than no time")
        self.spark, self.folder, self.owner = spark, folder.rstrip("/"), owner or uuid.uuid4().hex
        self.lease, self.clock = lease, clock
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def _create(self, path: str, text: str) -> bool:
        """Make a file if there is none of its name; False if there is one."""
        target = self._path(path)
        if self._files.getScheme() == "file":
            return self._link(self._files.makeQualified(target).toUri().getPath(), text)
        try:
            out = self._files.create(target, False)
        except Py4JJavaError as error:
            name = error.java_exception.getClass().getName()
            if name.endswith("FileAlreadyExistsException") or self._files.exists(target):
                return False
            raise
        try:
            out.write(text.encode())
        finally:
            out.close()
        return True

    def _link(self, target: str, text: str) -> bool:
        draft = f"{target}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(draft, "w", encoding="utf-8") as handle:
            handle.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True

    def _read(self, path: str) -> dict | None:
        """What a marker says; None where there is none, or not yet a whole one."""
        target = self._path(path)
        try:
            opened = self._files.open(target)
        except Py4JJavaError:
            return None
        try:
            return json.loads(bytes(opened.readAllBytes()).decode() or "null")
        except ValueError:
            return None
        finally:
            opened.close()

    def _text(self, until: float) -> str:
        return json.dumps({"owner": self.owner, "until": until})

    def take(self, path: str) -> Claim | None:
        """Claim the result at ``path``; None if it is there or somebody else holds it.

        A marker whose time is over, or that says nothing and is older than a lease, is taken
        away first, under a marker of its own, so that of several takers one goes on.
        """
        claim = Claim(path, self.owner, self.clock() + self.lease)
        if self._files.exists(self._path(path)):
            return None
        if not self._create(claim.marker, self._text(claim.until)) and not self._take_over(claim):
            return None
        if self._files.exists(self._path(path)):
            # It was finished between the two looks.
            self.release(claim)
            return None
        return claim

    def _is_over(self, marker: str) -> bool:
        said = self._read(marker)
        if said is not None:
            return float(said.get("until", 0.0)) < self.clock()
        try:
            modified = self._files.getFileStatus(self._path(marker)).getModificationTime() / 1000
        except Py4JJavaError:
            return False
        return modified + self.lease < self.clock()

    def _take_over(self, claim: Claim) -> bool:
        if not self._is_over(claim.marker):
            return False
        guard = f"{claim.marker}.takeover"
        if not self._create(guard, self._text(claim.until)):
            # A taker that died in these few steps leaves its guard behind.
            if self._is_over(guard):
                self._files.delete(self._path(guard), False)
            return False
        try:
            if not self._is_over(claim.marker):
                return False
            self._files.delete(self._path(claim.marker), False)
            return self._create(claim.marker, self._text(claim.until))
        finally:
            self._files.delete(self._path(guard), False)

    def holds(self, claim: Claim) -> bool:
        said = self._read(claim.marker)
        return said is not None and said.get("owner") == self.owner

    def renew(self, claim: Claim) -> Claim:
        """Hold on for another lease. An error if the claim has gone to somebody else."""
        if not self.holds(claim):
            raise RuntimeError(f"the claim on {claim.path} is no longer held by {self.owner}")
        renewed = Claim(claim.path, self.owner, self.clock() + self.lease)
        out = self._files.create(self._path(claim.marker), True)
        try:
            out.write(self._text(renewed.until).encode())
        finally:
            out.close()
        return renewed

    def release(self, claim: Claim) -> None:
        """Remove the marker, if it is still this worker's."""
        if self.holds(claim):
            self._files.delete(self._path(claim.marker), False)

    @contextmanager
    def claimed(self, path: str) -> Iterator[Claim | None]:
        """A claim, or None; removed at the end, also after an error."""
        claim = self.take(path)
        try:
            yield claim
        finally:
            if claim is not None:
                self.release(claim)

    def publish(self, claim: Claim, text: str) -> None:
        """Write a result in one step: under another name first, so nobody reads half of it.

        An error if the claim was lost: what somebody else makes is not overwritten.
        """
        if not self.holds(claim):
            raise RuntimeError(f"the claim on {claim.path} is no longer held by {self.owner}")
        draft = f"{claim.path}.{self.owner}.draft"
        out = self._files.create(self._path(draft), True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        if not self._files.rename(self._path(draft), self._path(claim.path)):
            self._files.delete(self._path(draft), False)
            raise RuntimeError(f"{claim.path} is there already")


def pending_in(spark: SparkSession, planned: DataFrame, folder: str) -> DataFrame:
    """Rows of ``planned`` (``path`` below ``folder``) with neither a result nor a marker there."""
    root = folder.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    qualified = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    below = list_files(spark, root)
    names = below.selectExpr(f"substring(path, {len(qualified) + 2}) AS path")
    return pending_results(planned, names)


def run_pending(
    spark: SparkSession,
    planned: DataFrame,
    folder: str,
    make: Callable[[object], str],
    order: Sequence[str] = ("path",),
    claims: Claims | None = None,
) -> Outcome:
    """Make what is pending, one after the other, each under a claim.

    ``planned`` has ``path`` (below ``folder``) and what ``make`` needs; there are a few results per
    model, so its rows come through the driver one by one. ``make`` gets a row and returns
    the text of its result. If it fails, the result stays pending and the next is made.
    Any number of workers may run this at once: they share the work.
    """
    root = folder.rstrip("/")
    held, outcome = claims or Claims(spark, root), Outcome()
    rows = pending_in(spark, planned, root).orderBy(*order)
    for row in rows.toLocalIterator():
        with held.claimed(f"{root}/{row.path}") as claim:
            if claim is None:
                outcome.taken.append(row.path)
                continue
            try:
                held.publish(claim, make(row))
                outcome.made.append(row.path)
            except Exception as error:  # the result stays pending
                outcome.failed[row.path] = f"{type(error).__name__}: {error}"
    return outcome
