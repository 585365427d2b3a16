"""Bringing images, poses and scans together as they arrive.

Bounded rings: 256 poses, 8 scans, 64 waiting images.  The oldest waiting image holds up the others
until it is bracketed by poses; an image older than all poses held is dropped and counted, and so is the
oldest of too many waiting ones.  At the end what is not bracketed is dropped.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import deque
from dataclasses import dataclass, field

from voxloom.streaming.keyed import RowStep

#: The sizes of the rings.
POSES, SCANS, PENDING = 256, 8, 64


def turn(a: float, b: float, t: float) -> float:
    """An angle between a and b, on the shorter arc."""
    return a + t * math.atan2(math.sin(b - a), math.cos(b - a))


@dataclass
class Sync:
    poses: deque = field(default_factory=lambda: deque(maxlen=POSES))
    scans: deque = field(default_factory=lambda: deque(maxlen=SCANS))
    pending: deque = field(default_factory=deque)
    emitted: int = 0
    too_old: int = 0
    overflow: int = 0

    def push_scan(self, t: int, pose: tuple[float, ...], scan_id: int) -> list[dict]:
        """A pose not newer than the last is ignored, its scan is kept."""
        if not self.poses or t > self.poses[-1][0]:
            self.poses.append((t, pose))
        self.scans.append((t, scan_id))
        return self.drain()

    def push_image(self, t: int, image_id: int) -> list[dict]:
        if len(self.pending) >= PENDING:
            self.pending.popleft()
            self.overflow += 1
        self.pending.append((t, image_id))
        return self.drain()

    def flush(self) -> list[dict]:
        out = self.drain()
        while self.pending:
            self.pending.popleft()
            self.too_old += 1
            out += self.drain()
        return out

    def sample(self, t: int) -> tuple[str, tuple[float, ...] | None]:
        """(status, pose at t): positions are interpolated linearly, the last component as an angle."""
        if not self.poses:
            return "EMPTY", None
        times = [p[0] for p in self.poses]
        i = bisect_left(times, t)
        if i == len(times):
            return "NEED_NEWER", None
        if times[i] == t:
            return "OK", self.poses[i][1]
        if i == 0:
            return "TOO_OLD", None
        (t0, a), (t1, b) = self.poses[i - 1], self.poses[i]
        f = (t - t0) / (t1 - t0) if t1 > t0 else 0.0
        return "OK", (*(x + (y - x) * f for x, y in zip(a[:-1], b[:-1], strict=True)), turn(a[-1], b[-1], f))

    def drain(self) -> list[dict]:
        out = []
        while self.pending:
            t, image = self.pending[0]
            status, pose = self.sample(t)
            if status in ("EMPTY", "NEED_NEWER"):
                break
            self.pending.popleft()
            if status == "TOO_OLD":
                self.too_old += 1
                continue
            # min() keeps the first of equals, and the ring is in order of arrival: the earlier scan.
            scan = min(self.scans, key=lambda s: abs(s[0] - t), default=(None, None))
            self.emitted += 1
            out.append({"image_t": t, "image_id": image, "scan_t": scan[0], "scan_id": scan[1], "pose": [float(x) for x in pose]})
        return out


FRAMES = "image_t long, image_id long, scan_t long, scan_id long, pose array<double>"


def step(key: str):
    """Fold step for rows (key, t, is_image, item, pose)."""

    def fold(state: Sync, rows: list[tuple]) -> tuple[Sync, list[tuple]]:
        out = []
        for run, t, is_image, item, pose in rows:
            found = state.push_image(t, item) if is_image else state.push_scan(t, tuple(pose), item)
            out += [(run, f["image_t"], f["image_id"], f["scan_t"], f["scan_id"], f["pose"]) for f in found]
        return state, out

    return RowStep([key, "t", "is_image", "item", "pose"], [key, "image_t", "image_id", "scan_t", "scan_id", "pose"], fold)
