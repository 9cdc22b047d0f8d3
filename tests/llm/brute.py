"""Plain one-document-at-a-time versions of the operators, written from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def repeats(texts: list[str | None], length: int = 100) -> list[tuple]:
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = [True] * length
            seen.add(data[i : i + length])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g))))
    return out


def simhash(text: str | None, size: int = 4) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(ids: list, prints: list[int], radius: int) -> dict:
    label = list(range(len(ids)))

    def root(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    members: dict[int, list] = {}
    for i, doc in enumerate(ids):
        members.setdefault(root(i), []).append(doc)
    return {doc: min((m for m in group if m is not None), default=None) for group in members.values() for doc in group}


def alike(ids: list, texts: list[str | None], size: int = 5) -> dict:
    """Smallest id of the group of every text, groups hanging together by a similarity of the shingle sets of 0.8 or more."""
    sets = []
    for text in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = {i: i for i in range(len(ids))}
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    members: dict[int, list] = {}
    for i, x in label.items():
        members.setdefault(x, []).append(ids[i])
    return {doc: min(group) for group in members.values() for doc in group}


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words7(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    words, hit, found = words7(text), set(), set()
    for item, content in items:
        other = words7(content)
        size = min(window, len(other))
        for i in range(len(other) - size + 1 if other else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == other[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(item)
    return len(words), len(hit), sorted(str(f) for f in found if f is not None)


def line_windows(rows: list[tuple]) -> dict:
    """(doc_id, text) in order -> doc_id: (kept text, lines, removed)."""
    seen, out = set(), {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        used = [i for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a in range(len(used) - 2):
            key = tuple(lines[i].strip(" \t\n\x0b\x0c\r") for i in used[a : a + 3])
            if key in seen:
                gone.update(used[a : a + 3])
            seen.add(key)
        out[doc] = ("\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def personal(text: str | None) -> list[str]:
    text, out = text or "", []
    out += [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        out += [f"card:{m.start()}:{m.end()}"] if 16 <= len(digits) <= 19 and total % 10 == 0 else []
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def quality(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
