"""Repairs that a decoder can prove: missing moves, a misread square, the other side to move, a path to a position."""

from __future__ import annotations

import re

from . import board as B
from . import notation_values as V
from .decoder import Decoder

#: How much dearer the runner-up must be, moves that must read, mean cost of a proof, most moves looked at.
MARGIN, LEAST_READ, MEAN, LOOK = 1.5, 4, 1.0, 12


def _tried(decoder: Decoder, p: B.Position, raws: list[str]) -> tuple[int, float]:
    """How many moves read from the start without a failure, and their cost."""
    read, cost = 0, 0.0
    for d in decoder.run(B.write_fen(p), raws) if raws else []:
        if d["status"] == "failed":
            break
        read, cost = read + 1, cost + d["cost"]
    return read, cost


def fill(decoder: Decoder, fen: str, following: list[str], missing: int = 1) -> list[str] | None:
    """The one or two missing moves that make the printed ones after them read, if no other choice comes near: the best must read at least
    four (or all) of them cheaply, and every other must stop before half as far or cost the margin more. None if that is not decided."""
    ahead = following[:LOOK]
    start = B.read_fen(fen)
    choices: list[tuple[list[str], B.Position]] = [([], start)]
    for _ in range(missing):
        choices = [([*names, B.san(p, m)], B.play(p, m)) for names, p in choices for m in B.legal(p)]
    for probe in (1, min(LEAST_READ, len(ahead))):  # rivals that stop at once go first
        alive = [(n, p) for n, p in choices if _tried(decoder, p, ahead[:probe])[0] == probe]
        choices = alive or choices
    scored = sorted(((-read, cost, names) for names, (read, cost) in ((n, _tried(decoder, p, ahead)) for n, p in choices)), key=lambda x: x[:2])
    if not scored:
        return None
    read, cost, names = -scored[0][0], scored[0][1], scored[0][2]
    if read < min(LEAST_READ, len(ahead)) or not read or cost / read > MEAN:
        return None
    for other_read, other_cost, _ in scored[1:]:
        if -other_read >= read / 2 and other_cost < cost + MARGIN:
            return None
    return names


def _sure(decoder: Decoder, fen: str, raws: list[str]) -> list[dict]:
    """The moves of a run up to the first in doubt; none unless the first is cheap and the first four (or all) read without doubt, with squares as printed."""
    rows = decoder.run(fen, raws) if raws else []
    good = 0
    for r in rows:
        printed, to = r["printed"], re.search(r"([a-h])([1-8])(?:=[QRBN])?[+#]?$", r["san"] or "")
        odd = [c for c, own in zip(printed, to.groups(), strict=False) if c not in (own, "-")] if to else []
        misread = any(c in "abcdefgh12345678" for c in odd) or (odd and r["cost"] > V.ON_SQUARE)
        if r["status"] != "ok" or misread:
            break
        good += 1
    need = min(V.ON_CHECK, len(rows))
    return rows[:good] if rows and good >= need and rows[0]["cost"] <= V.ON_COST else []


def read_on(decoder: Decoder, fen: str, ply: int, runs: list[tuple[int, str, list[str]]], declined: frozenset[str] = frozenset(), steps: int = V.ON_STEPS) -> tuple[list[dict], str]:
    """Go on by itself from a position before ply: runs (ply of the first move, key, printed moves) are taken in order. One that starts there is joined, one that starts one or two plies later if the missing moves
    are decided (fill); what is joined must read surely, and is cut where it does not. Steps made (how, key, moves, san of what was filled) and the reason to stop. No proof, no step."""
    made: list[dict] = []
    for at, key, raws in runs[:steps]:
        gap = at - ply
        if key in declined:
            return made, "the reader took this step back"
        if gap < 0:
            return made, "the next moves are a variation"
        if gap > V.ON_AHEAD:
            return made, "nothing more follows the line"
        if gap > V.ON_FILL:
            return made, "too many moves are missing"
        filled = fill(decoder, fen, raws, gap) if gap else []
        if filled is None:
            return made, "the missing moves are not decided"
        p = B.read_fen(fen)
        for name in filled:
            p = B.play(p, B.read_san(p, name))
        rows = _sure(decoder, B.write_fen(p), raws)
        if not rows:
            return made, "the next moves do not read surely"
        made.append({"how": "filled" if gap else "joined", "key": key, "filled": filled, "moves": [r["san"] for r in rows]})
        fen, ply = rows[-1]["fen"], at + len(rows)
        if len(rows) < len(raws):
            return made, "a printed move is in doubt"
    return made, "the step limit is reached" if len(runs) > steps else "the text is read to its end"


def square(decoder: Decoder, fen: str, raws: list[str]) -> str | None:
    """The position with the one square changed that makes all moves read, if exactly one change does."""
    p = B.read_fen(fen)
    if _tried(decoder, p, raws)[0] == len(raws):
        return fen
    found = []
    for k, piece in enumerate(p.squares):
        for c in ".PNBRQKpnbrqk":
            if c == piece or (c in "Pp" and k // 8 in (0, 7)):
                continue
            s = (*p.squares[:k], c, *p.squares[k + 1 :])
            if s.count("K") != 1 or s.count("k") != 1:
                continue
            q = p._replace(squares=s)
            if not B.in_check(q, not q.white) and _tried(decoder, q, raws)[0] == len(raws):
                found.append(B.write_fen(q))
                if len(found) > 1:
                    return None
    return found[0] if found else None


def region(decoder: Decoder, fen: str, raws: list[str]) -> tuple[list[dict], bool]:
    """Moves of a region read with the side that the position names, or with the other where that reads better; whether it was changed."""
    p = B.read_fen(fen)
    ways = []
    for changed in (False, True):
        q = p._replace(white=p.white != changed, passing=-1 if changed else p.passing)
        if not B.in_check(q, not q.white):
            rows = decoder.run(B.write_fen(q), raws)
            ways.append((sum(r["status"] == "failed" for r in rows), sum(r["cost"] for r in rows), changed, rows))
    best = min(ways, key=lambda w: w[:3])
    return best[3], best[2]


def path(start: str, placement: str, plies: int) -> list[str] | None:
    """Moves from a position to a placement in at most so many plies, the shortest; meeting squares prune what can't be reached."""
    goal = B.read_fen(placement).squares
    layer: list[tuple[B.Position, list[str]]] = [(B.read_fen(start), [])]
    for depth in range(plies + 1):
        for p, names in layer:
            if p.squares == goal:
                return names
        left = plies - depth - 1
        grown: dict[B.Position, list[str]] = {}
        for p, names in layer if depth < plies else ():
            for m in B.legal(p):
                q = B.play(p, m)
                if sum(a != b for a, b in zip(q.squares, goal, strict=True)) <= 4 * left and q not in grown:
                    grown[q] = [*names, B.san(p, m)]
        layer = list(grown.items())
    return None
