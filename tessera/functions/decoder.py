"""Constrained decoding of noisy move text: a learnt noise model and a beam search over legal moves.

The decoder asks the rules for the legal moves of a position only; each legal move is priced against
the printed token by what would have to be misread, and the cheapest sequence of the whole run wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from . import board as B
from . import notation_values as V

PIECES = "KQRBN"
#: The hyphen of long notation.
_LONG = re.compile(r"(?<=[a-h][1-8])[-–](?=[a-h£][1-8lI])")
#: Tokens whose cuts a decoder keeps from run to run.
MOST_CUTS = 20_000
#: Positions of a run whose options a decoder keeps.
MOST_FOUND = 10_000


@dataclass
class NoiseModel:
    """Counts of printed symbols by the piece they stood for."""

    symbols: dict[str, Counter] = field(default_factory=dict)
    #: What printed characters in the place of a file or a rank stood for, by (place, character); moves without a mark by (symbol, capture).
    places: dict[tuple[str, str], Counter] = field(default_factory=dict)
    unmarked: Counter = field(default_factory=Counter)
    letters: dict[str, str] = field(default_factory=lambda: dict(V.LETTERS["English"]))
    #: How many symbols were counted, and the tables made from them.
    seen: int = 0
    _known: dict = field(default_factory=dict, repr=False)

    def add(self, symbol: str, piece: str, n: int = 1) -> None:
        self.symbols.setdefault(symbol, Counter())[piece] += n
        self.seen += n

    def probability(self, symbol: str, piece: str) -> float:
        """(c + kappa * base) / (n + kappa) for a symbol that was seen; the base alone for another."""
        if symbol in V.FIGURINES:
            return 0.999 if V.FIGURINES[symbol] == piece else 1e-6
        base = V.PAWN_PRIOR if piece == "P" else V.PIECE_PRIOR
        if symbol in self.letters:
            base = 0.97 if self.letters[symbol] == piece else math.exp(-V.WRONG_LETTER)
        elif self.symbols and not (len(symbol) == 1 and symbol in "abcdefgh"):  # a lone file letter is a pawn's file unless seen whole
            base = self._backed(symbol)[piece]
        seen = self.symbols.get(symbol)
        if not seen:
            return base
        return (seen[piece] + V.KAPPA * base) / (sum(seen.values()) + V.KAPPA)

    def _backed(self, symbol: str) -> dict[str, float]:
        """What a symbol stands for by its characters: a row of log likelihoods a piece, averaged over the symbol's characters, beside how common the piece is; mixed with the prior."""
        if self._known.get("seen") != self.seen:
            self._known = {"seen": self.seen, **self._table()}
        known = self._known
        if symbol not in known["found"]:
            places = [known["place"].get(c, -1) for c in symbol]  # the last column is for characters not seen
            weight = known["common"] + V.BACK_WEIGHT * known["likely"][:, places].mean(1)
            share = np.exp(weight - np.logaddexp.reduce(weight))
            prior = np.array([V.PAWN_PRIOR if p == "P" else V.PIECE_PRIOR for p in PIECES + "P"])
            known["found"][symbol] = dict(zip(PIECES + "P", ((1 - V.BACK_PRIOR) * share + V.BACK_PRIOR * prior).tolist(), strict=True))
        return known["found"][symbol]

    def _table(self) -> dict:
        """Log shares of pieces, and of characters (columns) for each piece (rows), from all counts."""
        pieces = PIECES + "P"
        place = {c: k for k, c in enumerate(sorted(set("".join(self.symbols))))}
        counts, pieces_seen = np.zeros((len(pieces), len(place) + 1)), np.zeros(len(pieces))
        for text, by in self.symbols.items():
            n = np.array([by[p] for p in pieces], float)
            pieces_seen += n
            for c in text:
                counts[:, place[c]] += n
        smooth = counts + V.BACK_CHAR
        whole = counts.sum(1, keepdims=True) + V.BACK_CHAR * (len(place) + V.BACK_UNSEEN)
        common = np.log((pieces_seen + V.BACK_PIECE) / (pieces_seen.sum() + V.BACK_PIECE * len(pieces)))
        return {"place": place, "likely": np.log(smooth / whole), "common": common, "found": {}}

    def cost(self, symbol: str, piece: str) -> float:
        """How dear it is that a symbol stands for a piece, against the best it could stand for."""
        if not symbol:
            return 0.0 if piece == "P" else V.VANISHED
        best = max(self.probability(symbol, p) for p in "KQRBNP")
        return min(-math.log(max(self.probability(symbol, piece) / best, 1e-6)), V.MOST_PIECE_COST)

    def strong(self, symbol: str) -> bool:
        seen = self.symbols.get(symbol, Counter())
        n = sum(seen.values())
        return n >= V.STRONG_SEEN and max(seen.values()) >= V.STRONG_SHARE * n

    def place_cost(self, place: str, char: str, value: str, readings: dict[str, float]) -> float:
        """Cost of a file or rank for a printed character: the default, moved by what the character stood for in this text once it was seen often enough."""
        default = readings.get(value)
        seen = self.places.get((place, char))
        n = sum(seen.values()) if seen else 0
        if n < V.SQUARE_SEEN or (default is None and seen[value] < V.SQUARE_OTHER):
            return math.inf if default is None else default
        prior = math.exp(-(V.UNREAD if default is None else default))
        after = (seen[value] + V.SQUARE_KAPPA * prior) / (n + V.SQUARE_KAPPA)
        base = V.UNREAD if default is None else default
        return max(base + min(max(math.log(prior / max(after, 1e-9)), -2.0), 0.5), 0.0 if char == value else 0.1)

    def takes_mark(self, symbol: str) -> bool:
        """Whether a symbol without a capture mark nearly always captures: the print has the mark in the symbol."""
        yes, no = self.unmarked[(symbol, True)], self.unmarked[(symbol, False)]
        return bool(symbol) and yes >= V.IMPLIED_SEEN and yes >= V.IMPLIED_SHARE * (yes + no)

    def learn(self, decoded: list[dict]) -> None:
        """Symbols and squares of moves that were read without doubt; squares of those guessed too."""
        for d in decoded:
            if d["san"] and d["cost"] <= 2.5 and not d["san"].startswith("O"):
                for key in facts(d):
                    self.count(*key)

    def count(self, kind: str, char: str, value: str, n: int = 1) -> None:
        """Add one kind of fact: symbol, file, rank or mark."""
        if kind == "symbol":
            self.add(char, value, n)
        elif kind == "mark":
            self.unmarked[(char, value == "x")] += n
        else:
            self.places.setdefault((kind, char), Counter())[value] += n


def facts(d: dict) -> list[tuple[str, str, str]]:
    """What a decoded move teaches: (kind, printed, true)."""
    out = []
    to = re.search(r"([a-h])([1-8])(?:=[QRBN])?[+#]?$", d["san"])
    if to and d["printed"][0] != "-":
        out.append(("file", d["printed"][0], to[1]))
    if to and d["printed"][1] != "-":
        out.append(("rank", d["printed"][1], to[2]))
    if d["status"] == "ok":
        out.append(("symbol", d["symbol"], d["san"][0] if d["san"][0] in PIECES else "P"))
        if d["symbol"] and d["printed"][2] == "-":
            out.append(("mark", d["symbol"], "x" if "x" in d["san"] else "-"))
    return out


@dataclass(frozen=True)
class Reading:
    """One way to cut a printed token: symbol, disambiguation, capture mark, file and rank costs, promotion, signs."""

    symbol: str
    which: str
    capture: bool
    files: tuple[tuple[str, float], ...]
    ranks: tuple[tuple[str, float], ...]
    promote: str
    check: int
    printed: str = "--"


def _readings(raw: str) -> list[Reading]:
    """All cuts of a token; what stands before the square is the symbol, with or without a disambiguation and a capture mark."""
    body = _LONG.sub("", raw.strip(" \n\r\xa0").rstrip(".,;"))
    check = 0
    while body and body[-1] in "+#†‡!?":
        if body[-1] in "!?" and len(body) >= 2 and body[-2] in V.FILE_READINGS and not any(c in "12345678" for c in body[-3:-1]):
            break
        check = max(check, {"#": 3, "‡": 2, "+": 1, "†": 1}.get(body[-1], 0))
        body = body[:-1]
    variants = [(body, check)]
    if len(body) > 2 and body[-1] == "t" and body[-2] in V.RANK_READINGS:
        variants.insert(0, (body[:-1], max(check, 1)))
    out: list[Reading] = []
    for text, sign in variants:
        for rest, promote in _promotions(text):
            if len(rest) >= 2 and rest[-1] in V.RANK_READINGS and rest[-2] in V.FILE_READINGS:
                out += _heads(rest[:-2], tuple(V.FILE_READINGS[rest[-2]].items()), tuple(V.RANK_READINGS[rest[-1]].items()), promote, sign, rest[-2:])
            if rest and rest[-1] in "12345678":
                out += _heads(rest[:-1], (), tuple(V.RANK_READINGS[rest[-1]].items()), promote, sign, "-" + rest[-1])
            if rest and rest[-1] in "abcdefgh":
                out += _heads(rest[:-1], tuple(V.FILE_READINGS[rest[-1]].items()), (), promote, sign, rest[-1] + "-")
    return list(dict.fromkeys(out))


def _promotions(text: str) -> list[tuple[str, str]]:
    found = [(text, "")]
    if m := re.fullmatch(r"(.+[18lIsSB])=(.{1,6})", text):
        found.append((m[1], m[2]))
    elif m := re.fullmatch(r"(.*[a-h][18])([QRBN♕-♘])", text):
        found.append((m[1], m[2]))
    return found


def _heads(head: str, files: tuple, ranks: tuple, promote: str, sign: int, printed: str) -> list[Reading]:
    cuts = [(head, False)]
    marked = re.fullmatch(r"(.*?)(?:x:|:x|[xX×:])", head, re.S)
    if marked:
        cuts.append((marked[1], True))
    out = []
    for rest, capture in cuts:
        whole = bool(re.fullmatch("[KQRBN]?[a-h][1-8]", rest))  # long notation: the square it comes from is no part of a symbol
        if not whole:
            out.append(Reading(rest, "", capture, files, ranks, promote, sign, printed))
        for n in (2,) if whole else (1, 2):
            if len(rest) >= n and re.fullmatch("[a-h][1-8]|[a-h]|[1-8]", rest[-n:]):
                out.append(Reading(rest[:-n], rest[-n:], capture, files, ranks, promote, sign, printed))
    return out


class Decoder:
    """Reads runs of printed moves from a position."""

    def __init__(self, model: NoiseModel | None = None, beam: int = V.BEAM) -> None:
        self.model, self.beam = model or NoiseModel(), beam
        self._cuts: dict[str, list[Reading]] = {}
        self._clear()

    def _clear(self) -> None:
        """Forget what a run was priced at; cuts of tokens are the same for all runs, so that only their number is kept down."""
        self._squares: dict[tuple[str, int], list[tuple[Reading, float]]] = {}
        self._symbols: dict[tuple[str, str], float] = {}
        self._prices: dict[tuple[str, int, str], list[tuple[Reading, float, float, bool]]] = {}
        self._found: dict[tuple[str, B.Position], list[tuple]] = {}
        if len(self._cuts) > MOST_CUTS:
            self._cuts.clear()

    def _read(self, raw: str) -> list[Reading]:
        if raw not in self._cuts:
            self._cuts[raw] = _readings(raw)
        return self._cuts[raw]

    def _square(self, raw: str, to: int) -> list[tuple[Reading, float]]:
        """Cuts of a token that may show a square, and the cost of its file and rank."""
        key = raw, to
        if key not in self._squares:
            out, (file, rank) = [], B.name(to)
            for r in self._read(raw):
                cost = self.model.place_cost("file", r.printed[0], file, dict(r.files)) if r.files else V.MISSING_FILE
                cost += self.model.place_cost("rank", r.printed[1], rank, dict(r.ranks)) if r.ranks else V.MISSING_RANK
                if cost <= V.MAX_COST:
                    out.append((r, cost))
            self._squares[key] = out
        return self._squares[key]

    def _priced(self, raw: str, to: int, piece: str) -> list[tuple[Reading, float, float, bool]]:
        """Cuts of a token that may show a piece (P: a pawn) on a square: the cost of square and symbol, the symbol's share and whether it takes the capture mark in. No other part of a price is below zero, so what is too dear here is too dear at last."""
        key = raw, to, piece
        if key not in self._prices:
            out = []
            for r, cost in self._square(raw, to):
                sign = r.symbol, piece
                if sign not in self._symbols:
                    self._symbols[sign] = self.model.cost(*sign)
                if cost + self._symbols[sign] <= V.MAX_COST:
                    out.append((r, cost + self._symbols[sign], self._symbols[sign], not r.capture and self.model.takes_mark(r.symbol)))
            self._prices[key] = out
        return self._prices[key]

    def price(self, p: B.Position, m: B.Move, raw: str, after: B.Position | None = None) -> tuple[float, str, float, str]:
        """Least cost of a printed token for a legal move, the symbol of that reading, the symbol's share of the cost, and the printed file, rank and mark."""
        piece, which, to, capture, promote = B.parts(p, m)
        if piece.startswith("O"):
            zeros = sum(c in "O0o" for c in raw)
            if zeros < 2 or "-" not in raw:
                return math.inf, "", 0.0, "---"
            return V.OTHER_CASTLING if (zeros >= 3) != (piece == "O-O-O") else 0.0, piece, 0.0, "---"
        best = (math.inf, "", 0.0, "---")
        sign: int | None = None
        for r, cost, own_cost, takes in self._priced(raw, m.end, piece or "P"):
            if piece:
                if r.which and r.which != which:
                    own = B.name(m.start)
                    cost += V.DISAMBIGUATION_EXTRA if r.which in (own, own[0], own[1]) and not which else V.DISAMBIGUATION_WRONG if r.which not in (own, own[0], own[1]) else 0.0
                elif which and not r.which:
                    cost += V.DISAMBIGUATION_MISSING
            elif r.which != B.name(m.start):  # not the square that the pawn comes from
                if capture:
                    cost += 0.0 if r.which == which else V.DISAMBIGUATION_MISSING if not r.which else V.DISAMBIGUATION_WRONG
                elif r.which:
                    cost += V.PAWN_DISAMBIGUATION if r.which[0] == to[0] else V.DISAMBIGUATION_WRONG
            if takes:
                cost += 0.0 if capture else V.IMPLIED_NONCAPTURE
            elif r.capture != capture:
                cost += V.FALSE_CAPTURE if r.capture else V.MISSING_CAPTURE
            if cost >= best[0] or cost > V.MAX_COST:
                continue
            if sign is None:
                after = after or B.play(p, m)
                sign = (1 if any(B.kept(after, B.pseudo(after))) else 3) if B.in_check(after) else 0
            if bool(r.check) != bool(sign):
                cost += V.CHECK_FALSE if r.check else V.CHECK_MISSING
            elif r.check == 3 and sign == 1:
                cost += V.MATE_ON_CHECK
            if promote:
                cost += 0.0 if r.promote in ("", m.promote) and (r.promote or m.promote == "Q") else min(self.model.cost(r.promote, m.promote) if r.promote else 1.0, 2.0)
            elif r.promote:
                cost += V.PROMOTION_EXTRA
            if cost < best[0]:
                best = cost, r.symbol, own_cost, r.printed + ("x" if r.capture else "-")
        return best

    def options(self, p: B.Position, raw: str) -> list[tuple[float, B.Move, str, float, str, B.Position]]:
        """Legal moves that a token may stand for and the positions after them, cheapest first."""
        key = raw, p
        if key not in self._found:
            if len(self._found) >= MOST_FOUND:
                self._found.clear()
            castles = "-" in raw
            near = [m for m in B.pseudo(p) if self._priced(raw, m.end, p.squares[m.start].upper()) or (castles and p.squares[m.start] in "Kk" and abs(m.end - m.start) == 2)]
            played = ((m, B.play(p, m)) for m in (B.kept(p, near) if near else ()))
            found = ((*self.price(p, m, raw, after), m, after) for m, after in played)
            self._found[key] = sorted(((cost, m, symbol, share, printed, after) for cost, symbol, share, printed, m, after in found if cost <= V.MAX_COST), key=lambda x: (x[0], x[1]))
        return self._found[key]

    def _adapted(self, used: tuple, symbol: str, piece: str, own: float) -> float:
        """Cost of a symbol after what it stood for earlier in the run: (c + kappa * exp(-cost)) / (n + kappa)."""
        if not symbol or symbol in self.model.letters or symbol in V.FIGURINES:
            return own
        stood = [x for s, x in used if s == symbol]
        n, c = len(stood), stood.count(piece)
        return -math.log((c + V.KAPPA * math.exp(-own)) / (n + V.KAPPA))

    def run(self, start: str, raws: list[str]) -> list[dict]:
        """Read a run; one with a failure is searched again with four times the beam."""
        self._clear()
        rows, beam = self._search(start, raws), self.beam
        if beam == V.BEAM and any(r["status"] == "failed" for r in rows):
            self.beam = 4 * beam  # options found with the first beam are looked up
            try:
                return min(rows, self._search(start, raws), key=lambda x: sum(r["status"] == "failed" for r in x))
            finally:
                self.beam = beam
        return rows

    def _search(self, start: str, raws: list[str]) -> list[dict]:
        """One row a token: san, uci, status (ok, guessed, ambiguous or failed), cost, alternatives, symbol, fen."""
        first = B.read_fen(start)
        beam: list[tuple] = [(0.0, 0, first, (), ())]  # cost, fails, position, path, symbols used
        for raw in raws:
            grown: dict[tuple, tuple] = {}

            def keep(cost: float, fails: int, p: B.Position, path: tuple, used: tuple, grown: dict = grown) -> None:
                key = (p, fails)
                if key not in grown or cost < grown[key][0]:
                    grown[key] = cost, fails, p, path, used

            failing: list[tuple] = []
            for cost, fails, p, path, used in beam:
                found = self.options(p, raw)
                for c, m, symbol, own, printed, after in found:
                    piece = p.squares[m.start].upper()
                    c += self._adapted(used, symbol, piece, own) - own
                    keep(cost + c, 0, after, (*path, (m, c, symbol, printed)), (*used, (symbol, piece)) if symbol and not symbol.startswith("O") else used)
                if (not found or found[0][0] > V.FAIL_ABOVE) and fails < V.MAX_FAILS:
                    failing.append((cost, fails, p, path, used, not found))
            limit = min((g[0] for g in grown.values()), default=math.inf) + V.FAIL_WITHIN
            for cost, fails, p, path, used, blind in sorted((f for f in failing if f[0] + V.SKIP <= limit), key=lambda f: f[0])[: V.MOST_FAILING]:
                keep(cost + V.SKIP, fails + 1, p, (*path, (None, V.SKIP, "", "---")), used)
                for m in B.legal(p) if blind else ():
                    keep(cost + V.FAIL, fails + 1, B.play(p, m), (*path, (None, V.FAIL, m.uci(), "---")), used)
            if not grown:
                return self._rows(raws, beam[0], [], first)
            beam = sorted(grown.values(), key=lambda x: (x[0], x[1]))[: self.beam]
        return self._rows(raws, beam[0], beam[1:], first)

    def _rows(self, raws: list[str], best: tuple, others: list[tuple], p: B.Position) -> list[dict]:
        out = []
        for k, raw in enumerate(raws):
            step = best[3][k] if k < len(best[3]) else (None, V.FAIL, "", "---")
            m, cost, symbol, printed = step
            rivals = sorted({(round(o[0] - best[0], 6), o[3][k][0]) for o in others if k < len(o[3]) and o[3][k][0] not in (None, m) and o[0] - best[0] <= V.FIT_MARGIN}, key=lambda x: (x[0], x[1] or ()))
            if m is None:
                status, san, uci = "failed", None, None
                if symbol:
                    p = B.play(p, next(x for x in B.legal(p) if x.uci() == symbol))
                symbol = ""
            else:
                status = "ok" if not rivals else "ambiguous" if rivals[0][0] <= V.TIE else "guessed"
                san, uci = B.san(p, m), m.uci()
            names = [B.san(p, r) for _, r in rivals if r in B.legal(p)] if m else []
            if m is not None:
                p = B.play(p, m)
            out.append({"ply": k, "raw": raw, "san": san, "uci": uci, "status": status, "cost": round(cost, 6), "alternatives": names, "symbol": symbol, "printed": printed, "fen": B.write_fen(p)})
        return out
