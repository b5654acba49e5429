"""Online association of one clip's detections, frame by frame: a small state of active tracks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np

from .assignment import assign

FAR, ACCEPT = 1e6, 1e5
LEAST_STEP = 1e-3  # seconds that count as passed at least


@dataclass(frozen=True)
class TrackerOptions:
    """Fixed values of the association: gates, weights, memories and lifecycle."""

    most_missed: int = 15
    speed: float = 15.0
    high: float = 0.55
    low: float = 0.15
    crowd_factor: float = 1.6
    crowd_floor: int = 32
    crowd_history: int = 30
    slack: float = 1.5
    missed_slack: float = 0.15
    team_penalty: float = 3.0
    appearance_weight: float = 0.8
    appearance_keep: float = 0.85
    velocity_keep: float = 0.7
    box_keep: float = 0.8
    shape_gate: float = 1.0
    shape_weight: float = 0.6
    confidence_weight: float = 0.5
    use_shape: bool = True
    scale: tuple[float, ...] = (50.0, 30.0, 30.0, 45.0, 60.0, 60.0)

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class Track:
    id: int
    place: np.ndarray
    velocity: np.ndarray
    at: float
    confidence: float
    team: str
    appearance: np.ndarray | None
    box: np.ndarray | None
    missed: int = 0


@dataclass
class Detections:
    """One frame: places (n, 2), confidences of 0 to 1, teams, appearances (n, k) and box sizes (n, 2). The last two are None in all frames or in none."""

    at: float
    place: np.ndarray
    confidence: np.ndarray
    team: list[str]
    appearance: np.ndarray | None = None
    box: np.ndarray | None = None


@dataclass
class Tracks:
    """Active tracks as columns, a row for each, ids ascending; appearance and box are None without any."""

    id: np.ndarray
    place: np.ndarray
    velocity: np.ndarray
    at: np.ndarray
    confidence: np.ndarray
    team: np.ndarray
    appearance: np.ndarray | None
    box: np.ndarray | None
    missed: np.ndarray

    @classmethod
    def of(cls, tracks: list[Track]) -> Tracks:
        column = lambda name, kind: np.array([getattr(t, name) for t in tracks], kind)
        pairs = (column(c, float).reshape(-1, 2) for c in ("place", "velocity"))
        look, box = (None if not tracks or getattr(tracks[0], c) is None else column(c, float) for c in ("appearance", "box"))
        return cls(column("id", int), *pairs, column("at", float), column("confidence", float), column("team", object), look, box, column("missed", int))

    def __len__(self) -> int:
        return len(self.id)

    def __getitem__(self, i: int) -> Track:
        look, box = (None if x is None else x[i].copy() for x in (self.appearance, self.box))
        return Track(int(self.id[i]), self.place[i].copy(), self.velocity[i].copy(), float(self.at[i]), float(self.confidence[i]), self.team[i], look, box, int(self.missed[i]))

    def __iter__(self) -> Iterator[Track]:
        return (self[i] for i in range(len(self)))

    def _columns(self) -> list[np.ndarray | None]:
        return [self.id, self.place, self.velocity, self.at, self.confidence, self.team, self.appearance, self.box, self.missed]

    def taken(self, rows: np.ndarray) -> Tracks:
        return Tracks(*(None if x is None else x[rows] for x in self._columns()))

    def with_more(self, more: Tracks) -> Tracks:
        if not len(self):
            return more
        return Tracks(*(None if x is None else np.concatenate([x, y]) for x, y in zip(self._columns(), more._columns())))


@dataclass
class FieldTracker:
    """Its tracks may be given as a list."""

    options: TrackerOptions = TrackerOptions()
    tracks: Tracks | list[Track] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    next_id: int = 1
    burst: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.tracks, list):
            self.tracks = Tracks.of(self.tracks)
        self._scales: dict[int, np.ndarray] = {}

    def _scale(self, k: int) -> np.ndarray:
        if k not in self._scales:
            own = np.array(self.options.scale)
            self._scales[k] = np.concatenate([own, np.ones(max(0, k - len(own)))])[:k]
        return self._scales[k]

    def _cost(self, tracks: Tracks, d: Detections, rows: np.ndarray) -> np.ndarray:
        o = self.options
        dt = np.maximum(d.at - tracks.at, LEAST_STEP)
        apart = d.place[rows][None] - (tracks.place + tracks.velocity * dt[:, None])[:, None]
        away = np.sqrt(apart[..., 0] ** 2 + apart[..., 1] ** 2)
        near = away <= (o.speed * dt + o.slack + o.missed_slack * tracks.missed)[:, None]
        cost = away + o.confidence_weight * (1 - d.confidence[rows])[None]
        if d.appearance is not None:
            apart = (d.appearance[rows][None] - tracks.appearance[:, None]) / self._scale(tracks.appearance.shape[1])
            cost += o.appearance_weight * np.sqrt(np.add.reduce(apart * apart, axis=2))
        if o.use_shape and d.box is not None:
            # A detection without an extent is judged by the rest; a track without one takes no other.
            sized = (d.box[rows] > 0).all(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                change = np.abs(np.log(d.box[rows][None] / tracks.box[:, None]))
            near &= ~(sized[None] & (change.max(axis=2) > o.shape_gate))
            cost += np.where(sized[None], o.shape_weight * np.nan_to_num(np.linalg.norm(change, axis=2)), 0.0)
        number = {"unknown": 0}
        own, other = (np.array([number.setdefault(x, len(number)) for x in side]) for side in (tracks.team.tolist(), [d.team[r] for r in rows.tolist()]))
        other_known, own_known = other > 0, own > 0
        cost += o.team_penalty * ((own[:, None] != other) & own_known[:, None] & other_known)
        return np.where(near, cost, FAR)

    def _update(self, i: np.ndarray, d: Detections, r: np.ndarray) -> None:
        """Tracks of the numbers i go on with the detections r."""
        o, t = self.options, self.tracks
        dt = np.maximum(d.at - t.at[i], LEAST_STEP)
        t.velocity[i] = o.velocity_keep * t.velocity[i] + (1 - o.velocity_keep) * (d.place[r] - t.place[i]) / dt[:, None]
        t.place[i], t.at[i], t.missed[i] = d.place[r], d.at, 0
        t.confidence[i] = 0.8 * t.confidence[i] + 0.2 * d.confidence[r]
        if d.appearance is not None:
            t.appearance[i] = o.appearance_keep * t.appearance[i] + (1 - o.appearance_keep) * d.appearance[r]
        if d.box is not None:
            sized = (d.box[r] > 0).all(axis=1)
            t.box[i[sized]] = o.box_keep * t.box[i[sized]] + (1 - o.box_keep) * d.box[r[sized]]
        for k in (t.team[i] == "unknown").nonzero()[0].tolist():
            t.team[i[k]] = d.team[r[k]]

    def update(self, d: Detections) -> np.ndarray:
        """The track id of each detection, or -1."""
        o, n, high = self.options, len(d.confidence), d.confidence >= self.options.high
        ids, free = np.full(n, -1), np.arange(len(self.tracks))
        for rows in (high.nonzero()[0], (~high & (d.confidence >= o.low)).nonzero()[0]):
            if not len(free) or not len(rows):
                continue
            cost = self._cost(self.tracks if len(free) == len(self.tracks) else self.tracks.taken(free), d, rows)
            a, b = assign(cost)
            real = cost[a, b] < ACCEPT
            a, b = a[real], rows[b[real]]
            if len(a):
                self._update(free[a], d, b)
                ids[b] = self.tracks.id[free[a]]
                left = np.ones(len(free), bool)
                left[a] = False
                free = free[left]
        self.tracks.missed[free] += 1
        lasting = self.tracks.missed <= o.most_missed
        if not lasting.all():
            self.tracks = self.tracks.taken(lasting)
        before = sorted(self.counts)
        nominal = (before[(len(before) - 1) // 2] + before[len(before) // 2]) / 2 if before else float(n)
        self.burst = n > max(o.crowd_floor, o.crowd_factor * nominal)
        if not self.burst:
            self.counts = [*self.counts, n][-o.crowd_history :]
            new = ((ids < 0) & high).nonzero()[0]
            if len(new):
                new = new[np.lexsort((new, -d.confidence[new]))]
                m = len(new)
                ids[new] = np.arange(self.next_id, self.next_id + m)
                look, box = (None if x is None else x[new].astype(float) for x in (d.appearance, d.box))
                self.tracks = self.tracks.with_more(Tracks(ids[new], d.place[new].astype(float), np.zeros((m, 2)), np.full(m, d.at), d.confidence[new].astype(float), np.array([d.team[r] for r in new.tolist()], object), look, box, np.zeros(m, int)))
                self.next_id += m
        return ids


def box_overlap(a: np.ndarray, b: np.ndarray) -> float:
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, wide) * max(0.0, high)
    area = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / area if area > 0 else 0.0


@dataclass
class BoxTracker:
    """Association of boxes in the image: one minus overlap, and the distance of centres over the diagonal."""

    most_missed: int = 5
    gate: float = 1.4
    boxes: dict[int, np.ndarray] = field(default_factory=dict)
    missed: dict[int, int] = field(default_factory=dict)
    next_id: int = 1

    def update(self, boxes: np.ndarray) -> np.ndarray:
        ids, known = np.full(len(boxes), -1), sorted(self.boxes)
        if known and len(boxes):
            cost = np.empty((len(known), len(boxes)))
            for i, k in enumerate(known):
                t = self.boxes[k]
                diagonal = max(np.hypot(t[2] - t[0], t[3] - t[1]), 1.0)
                centres = np.hypot((boxes[:, 0] + boxes[:, 2] - t[0] - t[2]) / 2, (boxes[:, 1] + boxes[:, 3] - t[1] - t[3]) / 2)
                cost[i] = 1 - np.array([box_overlap(t, b) for b in boxes]) + centres / diagonal
            for i, j in zip(*assign(cost)):
                if cost[i, j] <= self.gate:
                    ids[j] = known[i]
        for k in known:
            self.missed[k] = 0 if k in ids else self.missed[k] + 1
        for k in [k for k in known if self.missed[k] > self.most_missed]:
            del self.boxes[k], self.missed[k]
        for j, b in enumerate(boxes):
            if ids[j] < 0:
                ids[j], self.next_id = self.next_id, self.next_id + 1
                self.missed[ids[j]] = 0
            self.boxes[ids[j]] = b
        return ids
