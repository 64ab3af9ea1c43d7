"""Assembly of a text's runs into lines of moves with variations and gaps, and their form as game text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import board as B
from . import notation as N
from . import notation_values as V
from .decoder import Decoder

#: Annotation signs and their numeric glyphs; results as printed and as stored.
NAGS = {"!": 1, "?": 2, "!!": 3, "??": 4, "!?": 5, "?!": 6}
V_RESULT = {"1-0": "1-0", "0-1": "0-1", "1/2-1/2": "1/2-1/2", "½-½": "1/2-1/2", "*": "*"}
#: Most plies of a gap, most characters of a comment.
MOST_GAP, MOST_COMMENT = 8, 2000


@dataclass
class Node:
    id: int
    parent: int | None
    line: int
    main: bool
    ply: int
    san: str | None
    raw: str
    status: str
    fen: str
    start: int
    end: int
    comment: str = ""


@dataclass
class Line:
    id: int
    start_fen: str
    title: str
    result: str
    nodes: list[Node] = field(default_factory=list)
    waiting: list[tuple[int, str, str]] = field(default_factory=list)
    #: The line of the chapter before that this one goes on from.
    joins: int | None = None


#: Words before a run that make it a threat (the other side passes), an alternative to the last move, a continuation of it or an example after it.
THREAT = re.compile(r"(?i)\b(?:threat(?:en(?:s|ed|ing)?|s)?|intending|with the idea(?: of)?)\b[^.;]{0,30}$")
ALTERNATIVE = re.compile(r"(?i)\b(?:or|instead|if|better(?: was)?|after)\b[^.;]{0,12}$")
FOLLOWS = re.compile(r"(?i)(?:\b(?:followed by|and then|then|e\.g\.|for example|namely)[^.;]{0,12})$")
#: Printed moves that show whether a run goes on from a position, characters before a run that are looked at.
PROBE, LEAD = 4, 60


def _reads(decoder: Decoder, fen: str, run: N.Run) -> bool:
    """Whether the first moves of a run read without a failure from a position."""
    return all(d["status"] != "failed" for d in decoder.run(fen, [t.raw for t in run.tokens[:PROBE]]))


class _Fold:
    """The state of one text's assembly: lines, the branches of the open one, and what interrupts it."""

    def __init__(self, text: str, decoder: Decoder, start: str, diagrams: list[tuple[int, str]], headings: list[int], before: Line | None) -> None:
        self.text, self.decoder, self.start, self.before = text, decoder, start, before
        self.diagrams, self.headings = sorted(diagrams), sorted(headings)
        self.lines: list[Line] = []
        self.branch: dict[int, list[Node]] = {}  # by depth, the nodes of the current branch in order of plies
        self.open: Line | None = None
        self.closed: list[tuple[Line, list[Node]]] = []
        self.count = 0

    def lead(self, at: int) -> str:
        return self.text[max(0, at - LEAD) : at].replace("\n", " ")

    def title(self, at: int) -> str:
        return self.text[max(0, at - 80) : at].rpartition("\n\n")[2].strip()[:80]

    def place(self, line: Line, run: N.Run, fen: str, parent: int | None, ply: int, main: bool) -> list[Node]:
        made = []
        for token, d in zip(run.tokens, self.decoder.run(fen, [t.raw for t in run.tokens]), strict=True):
            made.append(Node(self.count, parent, line.id, main, ply + len(made), d["san"], token.raw, d["status"], d["fen"], token.start, token.end))
            parent, self.count = self.count, self.count + 1
        return made

    def tried(self, line: Line, run: N.Run, fen: str, parent: int | None, ply: int) -> list[Node]:
        """The run as a variation, if it reads; nothing otherwise."""
        keep = self.count
        made = self.place(line, run, fen, parent, ply, False)
        if N.clean([None if n.status == "failed" else 0.0 for n in made]):
            return made
        self.count = keep
        return []

    def begin(self, run: N.Run, fen: str, ply: int, title: str) -> list[Node]:
        """Open a line whose main moves are the run's."""
        if self.open is not None and self.branch.get(0):
            self.closed.append((self.open, self.branch[0]))
        self.open = Line(len(self.lines), fen, title, "")
        self.lines.append(self.open)
        made = self.place(self.open, run, fen, None, ply, True)
        self.open.nodes += made
        self.branch = {0: made}
        return made

    def from_diagram(self, run: N.Run, ply: int) -> bool:
        """Open a line at the last diagram before a run, with the side that the run names, if the run reads from there."""
        near = [fen for at, fen in self.diagrams if at < run.start]
        if not near:
            return False
        p = B.read_fen(near[-1])._replace(white=not run.black_first, number=run.first_number, passing=-1)
        fen = B.write_fen(p)
        if B.in_check(p, not p.white) or not N.clean([None if d["status"] == "failed" else 0.0 for d in self.decoder.run(fen, [t.raw for t in run.tokens])]):
            return False
        self.begin(run, fen, ply, self.title(run.start))
        return True

    def overruled(self, run: N.Run, last: list[Node]) -> bool:
        """Whether a diagram after the line's last move shows another position, the line holds a doubtful move and the run reads from the diagram too: the line went wrong before it."""
        shown = [fen for at, fen in self.diagrams if last[-1].end <= at < run.start]
        if not shown or shown[-1].split(" ")[0] == last[-1].fen.split(" ")[0] or all(n.status == "ok" for n in last):
            return False
        p = B.read_fen(shown[-1])._replace(white=not run.black_first, passing=-1)
        return not B.in_check(p, not p.white) and _reads(self.decoder, B.write_fen(p), run)

    def held(self, run: N.Run, last: list[Node]) -> bool:
        """Whether a line that a heading or diagram interrupts goes on with the run: it must read from the line's position, and no diagram speak against it."""
        between = [at for at in (*self.headings, *(at for at, _ in self.diagrams)) if last[-1].end <= at < run.start]
        return not between or (_reads(self.decoder, last[-1].fen, run) and not self.overruled(run, last))

    def resumed(self, run: N.Run, ply: int) -> bool:
        """Go on with the line that was closed last, if the run's number and moves fit its end, no word makes it an alternative and no diagram stands between."""
        if not self.closed or ALTERNATIVE.search(self.lead(run.start)):
            return False
        line, nodes = self.closed[-1]
        if not nodes or nodes[-1].ply + 1 != ply or not nodes[-1].fen or any(nodes[-1].end <= at < run.start for at, _ in self.diagrams) or not _reads(self.decoder, nodes[-1].fen, run):
            return False
        self.closed.pop()
        if self.open is not None and self.branch.get(0):
            self.closed.append((self.open, self.branch[0]))
        self.open = line
        made = self.place(line, run, nodes[-1].fen, nodes[-1].id, ply, True)
        line.nodes += made
        self.branch = {0: nodes + made}
        return True

    def joined(self, run: N.Run, ply: int) -> bool:
        """Go on from the last line of the chapter before, if the first run of this one, before any heading or diagram, continues it."""
        main = [n for n in self.before.nodes if n.main] if self.before else []
        if self.lines or not main or not main[-1].fen or main[-1].ply + 1 != ply or self.before.waiting or any(at < run.start for at in (*self.headings, *(at for at, _ in self.diagrams))):
            return False
        if not _reads(self.decoder, main[-1].fen, run):
            return False
        self.begin(run, main[-1].fen, ply, self.before.title)
        self.open.joins = self.before.id
        return True

    def main_run(self, run: N.Run, ply: int) -> None:
        line, last = self.open, self.branch.get(0, [])
        following = last[-1].ply + 1 if last else 0
        follows = bool(last) and ply == following and bool(last[-1].fen) and self.held(run, last)
        if follows and ply:
            made = self.place(line, run, last[-1].fen, last[-1].id, ply, True)
            line.nodes += made
            self.branch = {0: last + made}
        elif ply and (self.joined(run, ply) or (THREAT.search(self.lead(run.start)) and self.note(run, ply)) or self.resumed(run, ply) or self.from_diagram(run, ply)):
            pass
        elif ply == 0:
            self.begin(run, self.start, 0, self.title(run.start))
        elif line is None:
            self.open = Line(len(self.lines), "", "", "", waiting=[(run.start, self.text[run.start : run.end], "no position to start from")])
            self.lines.append(self.open)
            self.branch = {}
        elif last and following < ply <= following + MOST_GAP:
            line.nodes.append(Node(self.count, last[-1].id, line.id, True, following, None, "", "gap", "", last[-1].end, run.start))
            self.count += 1
            line.waiting.append((run.start, self.text[run.start : run.end], f"{ply - following} plies are missing"))
            self.branch = {0: []}
        else:
            line.waiting.append((run.start, self.text[run.start : run.end], "does not follow the line"))

    def note(self, run: N.Run, ply: int) -> bool:
        """A run as a variation of the nearest branch that holds its ply, or, given as a threat, after a move that the other side passes; kept only if it reads."""
        line = self.open
        for depth in range(run.depth, -1, -1):
            nodes = self.branch.get(depth, [])
            at = [n for n in nodes if n.ply == ply - 1 and n.fen]
            if (at or (ply == 0 and depth == 0)) and not (run.depth == 0 and at and at[-1] is nodes[-1]):
                fen, parent = (at[-1].fen, at[-1].id) if at else (line.start_fen, None)
                if made := self.tried(line, run, fen, parent, ply):
                    line.nodes += made
                    self.branch[max(run.depth, 1)] = [n for n in nodes if n.ply < ply] + made
                    return True
        if THREAT.search(self.lead(run.start)):
            for depth in range(run.depth, -1, -1):
                at = [n for n in self.branch.get(depth, []) if n.ply == ply - 2 and n.fen]
                p = B.read_fen(at[-1].fen) if at else None
                if p is None or B.in_check(p):
                    continue
                q = p._replace(white=not p.white, passing=-1)
                passed = Node(self.count, at[-1].id, line.id, False, ply - 1, "--", "", "threat", B.write_fen(q), run.start, run.start)
                self.count += 1
                if made := self.tried(line, run, passed.fen, passed.id, ply):
                    line.nodes += [passed, *made]
                    return True
                self.count -= 1
        return False

    def bare(self, run: N.Run) -> None:
        """Moves without a number: an alternative to the last move before them, or what follows it, as the words say; kept only if they read."""
        lead = self.lead(run.start)
        other, after = ALTERNATIVE.search(lead), FOLLOWS.search(lead)
        earlier = [n for line in self.lines for n in line.nodes if n.end <= run.start and n.fen]
        if not earlier or not (other or after):
            return
        last = max(earlier, key=lambda n: n.end)
        line = self.lines[last.line]
        if after:
            fen, parent, ply = last.fen, last.id, last.ply + 1
        else:
            up = next((n for n in line.nodes if n.id == last.parent), None)
            fen, parent, ply = up.fen if up else line.start_fen, last.parent, last.ply
        if fen:
            line.nodes += self.tried(line, run, fen, parent, ply)


def assemble(text: str, decoder: Decoder, start: str = B.START, exact: bool = False, diagrams: list[tuple[int, str]] | None = None, headings: list[int] | None = None, before: Line | None = None) -> list[Line]:
    """Fold the runs in order. A main run that fits extends its line, over a heading or a diagram only if it reads there; one that starts at move 1 opens a line; one that fits the line closed last
    resumes it; the first of a chapter may go on from the chapter before. Diagrams (offset, position) may start a line. A few plies missing leave a gap node, and what follows waits. A run in brackets
    becomes a variation of the nearest branch that holds its ply, one that is given as a threat follows a passed move, and moves without a number are placed as their words say: all are kept only
    if they read. Anything else waits with a reason."""
    tokens = N.tokenize(text, exact)
    fold = _Fold(text, decoder, start, diagrams or [], headings or [], before)
    for run in N.runs(tokens):
        ply = 2 * (run.first_number - 1) + run.black_first
        if run.depth == 0:
            fold.main_run(run, ply)
        elif fold.open is not None and not fold.note(run, ply):
            fold.open.waiting.append((run.start, text[run.start : run.end], "fits no branch"))
    lines = fold.lines
    for run in N.bare_runs(tokens):
        fold.bare(run)
    results = [t for t in tokens if t.kind == "result"]
    for k, line in enumerate(lines):
        if not line.nodes:
            continue
        line.nodes.sort(key=lambda n: n.id)
        stop = next((x.nodes[0].start for x in lines[k + 1 :] if x.nodes), len(text) + 1)
        own = [t.raw for t in results if line.nodes[0].start <= t.start < stop]
        line.result = own[-1] if own else "*"
        placed = sorted(line.nodes, key=lambda n: (n.start, n.id))
        for a, b in zip(placed, placed[1:], strict=False):
            between = re.sub(r"[{}()\x00-\x1f]|[0-9]+\.(?:\.\.)?|…", " ", text[a.end : b.start])
            between = re.sub(r" +", " ", between).strip()
            a.comment = between[:MOST_COMMENT] if sum(c.isalpha() for c in between) >= 2 else ""
    return lines


def assemble_chapters(texts: list[str], decoder: Decoder, exact: bool = False) -> list[list[Line]]:
    """Chapters in order; the last line of each may go on in the next."""
    out: list[list[Line]] = []
    for text in texts:
        before = next((x for x in reversed(out[-1]) if x.nodes), None) if out else None
        out.append(assemble(text, decoder, exact=exact, before=before))
    return out


def game_text(line: Line) -> str:
    """One line as PGN: tags, then the tree with variations, comments and annotation glyphs; a gap is quoted as a comment."""
    children: dict[int | None, list[Node]] = {}
    for n in line.nodes:
        children.setdefault(n.parent, []).append(n)

    def walk(parent: int | None, numbered: bool) -> list[str]:
        out: list[str] = []
        while True:
            kids = sorted(children.get(parent, []), key=lambda n: (not n.main, n.id))
            if not kids:
                return out
            first, *rest = kids
            out += show(first, numbered)
            for other in rest:
                out += ["(", *show(other, True), *walk(other.id, bool(other.comment)), ")"]
            numbered, parent = bool(rest or first.comment or first.san is None), first.id

    def show(n: Node, numbered: bool) -> list[str]:
        if n.san is None:
            return ["{gap}"] if n.status == "gap" else [f"{{unread: {re.sub(r'[{}]', ' ', n.raw)}}}"]
        head = [f"{n.ply // 2 + 1}."] if n.ply % 2 == 0 else [f"{n.ply // 2 + 1}..."] if numbered else []
        sign = re.search(r"[!?]{1,2}$", n.raw)
        return [*head, n.san, *([f"${NAGS[sign[0]]}"] if sign and sign[0] in NAGS and n.status == "ok" else []), *([f"{{{n.comment}}}"] if n.comment else [])]

    tags = {"Event": line.title or "?", "Site": "?", "Date": "????.??.??", "Round": "?", "White": "?", "Black": "?", "Result": V_RESULT.get(line.result, "*")}
    if line.start_fen not in ("", B.START):
        tags |= {"SetUp": "1", "FEN": line.start_fen}
    quoted = lambda v: re.sub(r"[\x00-\x1f]", " ", v).replace("\\", "\\\\").replace('"', '\\"')
    body = " ".join([*walk(None, True), tags["Result"]]).replace("( ", "(").replace(" )", ")")
    return "".join(f'[{k} "{quoted(v)}"]\n' for k, v in tags.items()) + "\n" + body + "\n"


def main_moves(pgn: str) -> list[str]:
    """The main moves of game text: comments, variations, numbers and glyphs left out."""
    body = re.sub(r"\{[^}]*\}", " ", pgn.partition("\n\n")[2])
    while "(" in body and (cut := re.sub(r"\([^()]*\)", " ", body)) != body:
        body = cut
    return [w for w in re.sub(r"\b[0-9]+\.+|\$[0-9]+", " ", body).split() if w not in V_RESULT]


def find_diagram(rows: list[str]) -> str | None:
    """Eight lines of letters, dots or chess signs as a placement; None if they are no board."""
    empty = ".-+*_ ·□■"
    out = []
    for row in rows:
        row = row[::2] if len(row) >= 15 and all(c == " " for c in row[1::2]) else row
        cells = ["." if c in empty else c if c in "pnbrqkPNBRQK" else {k: v if k in "♔♕♖♗♘♙" else v.lower() for k, v in V.FIGURINES.items()}.get(c) for c in row]
        if len(cells) != 8 or None in cells:
            return None
        out.append(re.sub(r"\.+", lambda m: str(len(m[0])), "".join(cells)))
    place = "/".join(out)
    return place if place.count("K") == 1 and place.count("k") == 1 and not re.search("[Pp]", out[0] + out[7]) else None


def listing(line: Line) -> list[tuple[int, int, str]]:
    """Place, depth and text of a line's moves, each variation right after the move that it replaces."""
    children: dict[int | None, list[Node]] = {}
    for n in line.nodes:
        children.setdefault(n.parent, []).append(n)
    out: list[tuple[int, int, str]] = []

    def walk(parent: int | None, depth: int) -> None:
        while kids := sorted(children.get(parent, []), key=lambda n: (not n.main, n.id)):
            first, *rest = kids
            show(first, depth)
            for other in rest:
                show(other, depth + 1)
                walk(other.id, depth + 1)
            parent = first.id

    def show(n: Node, depth: int) -> None:
        out.append((len(out), depth, f"{n.ply // 2 + 1}{'...' if n.ply % 2 else '.'} {n.san or '?'} {n.status}"))

    walk(None, 0)
    return out
