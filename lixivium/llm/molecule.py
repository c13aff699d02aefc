"""SMILES read into a graph and written in one canonical way, whatever tool wrote it.

Atoms are told by element and number of hydrogens, bonds only by what they join: the hydrogens fix the bond orders up to
resonance, so aromatic and Kekulé forms of one molecule come out alike. Stereo marks, components beside the largest, and a
charge that others balance (it is taken back with its hydrogens) don't count; nor does anything after the first blank.
Many molecules are ranked at once: the colours of all their atoms are refined together in numpy arrays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np

# SMILES tokens and the usual valences of the organic subset.
_TOKENS = re.compile(r"\[[^\[\]]*\]|Br|Cl|[BCNOPSFIbcnops]|%\d\d|\d|[-=#$:/\\~]|[()]|\.|\*")
_BRACKET = re.compile(r"\[(\d*)([A-Z][a-z]?|[a-z][a-z]?|\*)(@{0,2}[A-Z0-9]*?)(H\d*)?([+-]+\d*|[+-]\d+)?(?::\d+)?\]$")
_VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
_ORDER = {"-": 1, "=": 2, "#": 3, "$": 4, ":": 1, "/": 1, "\\": 1, "~": 1}

#: Implicit hydrogens of an organic-subset atom by the sum of its bond orders; of an aromatic one, ring bonds count 1.
_IMPLICIT = {e: [next((v - b for v in vs if v >= b), 0) for b in range(64)] for e, vs in _VALENCES.items()} | {e: [max(0, 3 - b) if e in "bc" else 0 for b in range(64)] for e in "bcnops"}
_ATOMS = {e: (e.capitalize(), -1, 0) for e in _IMPLICIT} | {"*": ("*", 0, 0)}  # element, hydrogens (-1: by its bonds), charge

Graph = tuple[list[str], list[int], list[int], list[list[int]]]


@lru_cache(maxsize=4096)
def _bracket(text: str) -> tuple[str, int, int] | None:
    """Element, hydrogens and charge of a bracket atom."""
    m = _BRACKET.match(text)
    if m is None:
        return None
    h, sign = m.group(4), m.group(5) or ""
    q = 0
    if sign:
        digits = sign.strip("+-")
        q = (int(digits) if digits else len(sign)) * (-1 if sign[0] == "-" else 1)
    return m.group(2).capitalize(), int(h[1:] or 1) if h else 0, q


def parse(smiles: str) -> Graph | None:
    """Elements, hydrogens, charges and neighbours of each heavy atom; None if it can't be read."""
    tokens = _TOKENS.findall(smiles)
    if sum(map(len, tokens)) != len(smiles):
        return None
    symbol: list[str] = []
    fixed: list[int] = []  # hydrogens, or -1 where they follow from the bonds
    raw: list[str] = []
    charge: list[int] = []
    near: list[list[int]] = []
    bonds: list[int] = []
    stack: list[int] = []
    rings: dict[str, tuple[int, int]] = {}
    prev, order, opened, n = -1, 0, False, 0
    for t in tokens:
        atom = _ATOMS.get(t)
        if atom is not None or t[0] == "[":
            if atom is None:
                atom = _bracket(t)
                if atom is None:
                    return None
            symbol.append(atom[0])
            fixed.append(atom[1])
            charge.append(atom[2])
            raw.append(t)
            if prev >= 0:
                near.append([prev])
                near[prev].append(n)
                bonds.append(order or 1)
                bonds[prev] += order or 1
            elif order:
                return None
            else:
                near.append([])
                bonds.append(0)
            prev, order, opened = n, 0, False
            n += 1
        elif t == "(":
            if order or prev < 0:
                return None
            stack.append(prev)
            opened = True
        elif t == ")":
            if order or opened or not stack:
                return None
            prev = stack.pop()
        elif t in _ORDER:
            if order or prev < 0:
                return None
            order = _ORDER[t]
        elif t == ".":
            if order or stack or prev < 0:
                return None
            prev = -1
        else:
            if prev < 0:
                return None
            t = t.lstrip("%0") or "0"
            if t in rings:
                other, o = rings.pop(t)
                if other == prev or other in near[prev]:
                    return None
                near[prev].append(other)
                near[other].append(prev)
                bonds[prev] += order or o or 1
                bonds[other] += order or o or 1
            else:
                rings[t] = (prev, order)
            order = 0
    if rings or stack or order or prev < 0:
        return None
    h = [f if f >= 0 else _IMPLICIT[r][b] for f, r, b in zip(fixed, raw, bonds, strict=True)]
    if "H" in symbol:  # explicit hydrogen atoms become hydrogens of their neighbour
        for i, e in enumerate(symbol):
            if e == "H" and len(near[i]) == 1 and symbol[near[i][0]] != "H":
                j = near[i][0]
                h[j] += 1
                near[j].remove(i)
                near[i] = []
                symbol[i] = ""
    if any(charge):
        _neutral(h, charge, near)
    return symbol, h, charge, near


def _neutral(h: list[int], q: list[int], near: list[list[int]]) -> None:
    """Takes charges back: neighbours of opposite charge share a further bond, the others lose or win hydrogens."""
    for i, c in enumerate(q):
        if c > 0:
            for j in near[i]:
                if q[j] < 0 and q[i] > 0:
                    q[i] -= 1
                    q[j] += 1
    for i, c in enumerate(q):
        if c < 0 or (c > 0 and h[i] >= c):
            h[i] -= c
            q[i] = 0


class _Labels(dict):
    """The text of an atom by (element, hydrogens, charge), made when it is first met; there are a few hundred."""

    def __missing__(self, atom: tuple[str, int, int]) -> str:
        element, hydrogens, charge = atom
        self[atom] = text = f"{element}{hydrogens or ''}{f'{charge:+d}' if charge else ''}"
        return text


class _Seeds(dict):
    """A 64 bit number for each label."""

    def __missing__(self, label: str) -> int:
        self[label] = seed = int.from_bytes(hashlib.blake2b(label.encode(), digest_size=8).digest(), "little")
        return seed


_label, _seed = _Labels(), _Seeds()


def components(graph: Graph, whole: bool = False) -> list[tuple[list[str], list[list[int]]]]:
    """Labels and neighbours of the largest components: one, or several of the same size. whole: it is known to be one."""
    symbol, h, q, near = graph
    label = list(map(_label.__getitem__, zip(symbol, h, q, strict=True)))
    if whole:
        return [(label, near)]
    seen: set[int] = set()
    parts: list[list[int]] = []
    for first in range(len(symbol)):
        if first not in seen and symbol[first]:
            atoms, todo = [], [first]
            seen.add(first)
            while todo:
                a = todo.pop()
                atoms.append(a)
                for b in near[a]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            parts.append(sorted(atoms))
            if len(atoms) == len(symbol):
                return [(label, near)]
    most = max(map(len, parts), default=0)
    out = []
    for atoms in parts:
        if len(atoms) == most:
            place = {a: i for i, a in enumerate(atoms)}
            out.append(([label[a] for a in atoms], [[place[b] for b in near[a]] for a in atoms]))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOCAL = 4  # bonds around an atom that decide its place before the whole molecule does
ROUNDS = 4  # of refinement before a molecule is looked at again


class _Atoms:
    """The atoms of many molecules, each molecule's in a row, with their neighbours as one array."""

    def __init__(self, sizes: np.ndarray, degree: np.ndarray, target: np.ndarray) -> None:
        self.sizes, self.degree, self.target = sizes, degree, target
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.bounds = np.concatenate([[0], np.cumsum(degree)])

    def part(self, molecules: np.ndarray) -> tuple[_Atoms, np.ndarray]:
        """Some of the molecules (a mask) and where their atoms are here."""
        keep = molecules[self.owner]
        place = np.cumsum(keep) - 1
        return _Atoms(self.sizes[molecules], self.degree[keep], place[self.target[np.repeat(keep, self.degree)]]), np.flatnonzero(keep)

    def refine(self, c: np.ndarray, rounds: int) -> np.ndarray:
        """Colours after so many rounds, each of which adds what an atom's neighbours have."""
        total = np.zeros(len(self.target) + 1, np.uint64)
        for _ in range(rounds):
            np.cumsum(_mix(c)[self.target], out=total[1:])
            c = _mix(c * np.uint64(0x9E3779B97F4A7C15) + total[self.bounds[1:]] - total[self.bounds[:-1]])
        return c

    def classes(self, c: np.ndarray) -> np.ndarray:
        """How many colours each molecule has."""
        key = np.sort((self.owner.astype(np.uint64) << np.uint64(40)) | (c >> np.uint64(24)))
        return np.add.reduceat(np.concatenate([[True], key[1:] != key[:-1]]).astype(np.int64), self.starts)

    def settled(self, c: np.ndarray) -> np.ndarray:
        """Colours refined until a round adds none. How long that takes depends on the molecule alone, so that it is ranked alike
        in any company."""
        c = self.refine(c, ROUNDS)
        after = self.refine(c, 1)
        going = self.classes(after) != self.classes(c)
        if going.any():
            rest, at = self.part(going)
            after[at] = rest.settled(after[at])
        return after


def _rank(labels: Sequence[list[str]], nears: Sequence[list[list[int]]]) -> list[list[int]]:
    """For each molecule its atoms in canonical order: by what lies within one bond of an atom, then two, and so on up to the
    whole molecule, so that a change in one place leaves the order elsewhere mostly as it was."""
    sizes = np.array([len(x) for x in labels])
    shift = np.repeat(np.cumsum(sizes) - sizes, [sum(map(len, near)) for near in nears])
    degree = np.array(list(map(len, chain.from_iterable(nears))))
    all_ = _Atoms(sizes, degree, np.fromiter(chain.from_iterable(chain.from_iterable(nears)), np.int64, int(degree.sum())) + shift)
    first_near = all_.target[np.minimum(all_.bounds[:-1], max(len(all_.target) - 1, 0))] if len(all_.target) else np.zeros(len(degree), np.int64)
    only = np.where(degree == 1, first_near, -1 - np.arange(len(degree)))  # the one neighbour of an end atom
    with np.errstate(over="ignore"):
        local = [np.array(list(map(_seed.__getitem__, chain.from_iterable(labels))), np.uint64)]  # what lies within 0, 1, ... bonds of an atom
        for _ in range(LOCAL):
            local.append(all_.refine(local[-1], 1))
        colour = all_.settled(local[-1])
        some, at = all_, np.arange(len(colour))
        while True:  # symmetric atoms: one of the lowest tied colour goes first, which of them makes no difference
            own = colour[at]
            order = np.argsort((some.owner.astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24)))
            a, b = order[1:], order[:-1]
            # like end atoms of one atom may stay tied: exchanging them changes nothing
            tied = np.flatnonzero((own[a] == own[b]) & (some.owner[a] == some.owner[b]) & (only[at[a]] != only[at[b]]))
            if not len(tied):
                break
            molecules, first = np.unique(some.owner[b[tied]], return_index=True)
            chosen = at[b[tied[first]]]
            colour[chosen] = _mix(colour[chosen] ^ np.uint64(0xD6E8FEB86659FD93))
            mask = np.zeros(len(some.sizes), bool)
            mask[molecules] = True
            some, inside = some.part(mask)
            at = at[inside]
            colour[at] = some.settled(colour[at])
        packed = np.zeros(len(colour), np.uint64)  # some bits of each, the nearest first; what they don't tell, colour does
        for c in local:
            packed = packed << np.uint64(64 // len(local)) | c >> np.uint64(64 - 64 // len(local))
        order = np.lexsort((colour, packed, all_.owner)) - np.repeat(all_.starts, sizes)
    return [order[a:b].tolist() for a, b in zip(all_.starts.tolist(), (all_.starts + sizes).tolist(), strict=True)]


def _write(order: list[int], label: list[str], near: list[list[int]]) -> str:
    """The graph from its first atom on, depth first: each atom's label, ^ and how far back its parent is if not the one
    before, & and how far back each further neighbour is. Like parts read alike wherever they stand."""
    rank = [0] * len(order)
    for r, a in enumerate(order):
        rank[a] = r
    place = [-1] * len(order)
    out: list[str] = []
    todo = [(order[0], -1)]
    key = rank.__getitem__
    n = 0
    while todo:
        a, parent = todo.pop()
        if place[a] >= 0:
            continue
        place[a] = n
        text = label[a]
        if parent >= 0 and n - place[parent] != 1:
            text += f"^{n - place[parent]}"
        own = near[a]
        for b in sorted(own, key=key, reverse=True) if len(own) > 1 else own:
            if b != parent:
                if place[b] >= 0:
                    text += f"&{n - place[b]}"
                else:
                    todo.append((b, a))
        out.append(text)
        n += 1
    return "".join(out)


def canonical_texts(smiles: Sequence[str | None]) -> list[str | None]:
    """The canonical text of the largest component of each; None for null, blank and unreadable SMILES."""
    members: list[tuple[int, list[str], list[list[int]]]] = []
    for i, s in enumerate(smiles):
        words = s.split(None, 1) if s else []
        graph = parse(words[0]) if words else None
        if graph is not None:
            members += [(i, label, near) for label, near in components(graph, "." not in words[0] and "" not in graph[0])]
    out: list[str | None] = [None] * len(smiles)
    orders = _rank([m[1] for m in members], [m[2] for m in members]) if members else []
    for (i, label, near), order in zip(members, orders, strict=True):
        text = _write(order, label, near)
        if out[i] is None or text > out[i]:
            out[i] = text
    return out


def canonical(smiles: str | None) -> str | None:
    return canonical_texts([smiles])[0]
