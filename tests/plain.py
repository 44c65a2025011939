"""Plain versions of the queries that SQL can't say."""

import math
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np


def words(text):
    """(line, place, word, left, top, right, bottom) as the queries lay documents out."""
    for i, line in enumerate(text.split("\n")):
        for j, w in enumerate(x for x in line.split(" ") if x):
            left, top = j % 12 * 50, i * 30 + j // 12 * 14
            yield i, j, w, left, top, left + min(len(w) * 6, 48), top + 12


def reading_order(text):
    """word id: (line, position), both from 1."""
    boxes = sorted((top, left, f"word_{i}_{j}") for i, j, _, left, top, _, _ in words(text))
    lines, first = [], None
    for top, left, name in boxes:
        if first is None or abs(top - first) > 10:
            lines.append([])
            first = top
        lines[-1].append((left, top, name))
    order = [(k, name) for k, line in enumerate(lines, 1) for _, _, name in sorted(line)]
    return {name: (k, n) for n, (k, name) in enumerate(order, 1)}


def suppressed(faces):
    """faces: (order, left, top, width, height, score); the orders kept."""
    faces = [(o, int(x), int(y), max(1, int(w)), max(1, int(h)), s) for o, x, y, w, h, s in faces if np.float32(s) > np.float32(0.7)]
    kept = []
    for o, x, y, w, h, _ in sorted(faces, key=lambda f: (-f[5], f[0])):
        fits = True
        for _, a, b, c, d in kept:
            both = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
            fits = fits and both <= np.float32(0.3) * (w * h + c * d - both)
        if fits:
            kept.append((o, x, y, w, h))
    return {k[0] for k in kept}


def decoded(level, stride, scale_x, scale_y):
    """Faces of one level of two cells: 2 classes, 2 objects, 8 of boxes, 20 of landmarks."""
    for i in range(2):
        c, o = (min(1.0, max(0.0, abs(level[k + i]) * 5)) for k in (0, 2))
        score = math.sqrt(c * o)
        if score < 0.7:
            continue
        b, p = level[4 + 4 * i : 8 + 4 * i], level[12 + 10 * i : 22 + 10 * i]
        x, y, w, h = (i + b[0]) * stride, b[1] * stride, math.exp(b[2]) * stride, math.exp(b[3]) * stride
        yield ((x - w / 2) * scale_x, (y - h / 2) * scale_y, w * scale_x, h * scale_y, [(v + i) * stride * scale_x if k % 2 == 0 else v * stride * scale_y for k, v in enumerate(p)], score)


def canonical(text):
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().upper()
    return " ".join(re.sub("[^0-9A-Z]+", " ", plain).split())


TOKEN = re.compile("[A-Z0-9<]+(?:[/-][A-Z0-9<]+)*")


def tagged(text):
    """The tags, without O, of a document's second line as surname (first word) and given names (the others)."""
    tokens = [t for _, _, w, *_ in words(text) for t in TOKEN.findall(w.upper())]
    match = [re.sub("[^A-Z0-9<]", "", t) for t in tokens]
    tags = ["O"] * len(tokens)
    lines = text.split("\n")
    line = [w for w in (lines[1] if len(lines) > 1 else "").split(" ") if w]
    for tag, value in (("SURNAME", " ".join(line[:1])), ("GIVEN_NAMES", " ".join(line[1:]))):
        s = [re.sub("[^A-Z0-9<]", "", t) for t in TOKEN.findall(value.upper())]
        for i in range(len(match) - len(s) + 1) if s else ():
            if match[i : i + len(s)] == s and tags[i : i + len(s)] == ["O"] * len(s):
                tags[i : i + len(s)] = [f"B-{tag}"] + [f"I-{tag}"] * (len(s) - 1)
                break
    for form in (["2020-02-01"], ["01/02/2020"], ["01-02-2020"], ["01022020"], ["200201"]):  # the date that every document is given
        s = [re.sub("[^A-Z0-9<]", "", t) for t in form]
        at = next((i for i in range(len(match)) if match[i : i + 1] == s and tags[i] == "O"), None)
        if at is not None:
            tags[at] = "B-DOB"
            break
    return len(tokens), " ".join(t for t in tags if t != "O")


def similar(a, b):
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def f1(a, b):
    a, b = set(a.split()), set(b.split())
    return 2.0 * len(a & b) / (len(a) + len(b)) if a & b else 0.0


def scored(kind, value, text, normalized):
    """(score, how) of one candidate; dates are those of the fixture, 01/02/2020."""
    n, e, c = canonical(value), canonical(value).replace(" ", ""), normalized.replace(" ", "")
    if kind == "code":
        codes = {"F", "FEMALE", "NU"}
        return (1.0, "exact") if c in codes or normalized in codes else (0.0, "none")
    if kind == "country":
        return (0.0, "none") if len(e) != 3 else (1.0, "exact") if c == e else (0.92, "contains") if c.startswith(e) else (0.0, "none")
    if kind == "date":
        forms = {"2020-02-01", "20200201", "01/02/2020", "01-02-2020", "01022020", "200201", "2020-02", "202002", "02-2020", "02/2020"}
        found = {"".join(re.findall(r"\d+", x)) for x in (text, normalized, c)}
        whole = [re.fullmatch(r"(\d{1,2})([/-])(\d{1,2})\2(\d{4})", y) for x in (text, normalized, c) for y in (x, x.replace(" ", ""))]
        same = any(m and (int(m[1]), int(m[3]), int(m[4])) == (1, 2, 2020) for m in whole)
        return (1.0, "date") if same or any(len(x) == 8 and x in forms for x in found) else (0.0, "none")
    if kind == "identifier":
        if not e or not c:
            return 0.0, "none"
        if c == e:
            return 1.0, "exact"
        if c.startswith(e) or e.startswith(c):
            return min(0.96, 0.88 + len(c) / len(e) * 0.08), "prefix"
        return similar(e, c) * 0.9, "fuzzy"
    if not n or not normalized:
        return 0.0, "none"
    if normalized == n or c == e:
        return 1.0, "exact"
    s = max(similar(n, normalized), similar(e, c))
    contains = len(e) >= 4 and (e in c or c in e)
    score = min(s * 0.5 + f1(n, normalized) * 0.35 + (0.15 if contains else 0.0), 0.99)
    return score, "contains" if contains and s >= 0.65 else "fuzzy"


KINDS = {"surname": "text", "passport_number": "identifier", "issuing_country": "country", "sex": "code", "date_of_issue": "date"}


def best_matches(text):
    """field: (value, text, score, how) of the best candidate, the first of equals."""
    lines = text.split("\n")
    second = [w for w in (lines[1] if len(lines) > 1 else "").split(" ") if w] + [""] * 4
    expected = {"surname": " ".join(second[:2]), "passport_number": second[2], "issuing_country": second[3], "sex": "F", "date_of_issue": "01/02/2020"}
    found = []
    for i, line in enumerate(lines):
        own = [w for w in line.split(" ") if w]
        nth = 0
        for a in range(len(own)):
            for k in range(1, min(8, len(own) - a) + 1):
                normalized = " ".join(x for x in map(canonical, own[a : a + k]) if x)
                found.append((i, nth, " ".join(own[a : a + k]), normalized))
                nth += 1
        found.append((i, 1 << 30, line.strip(), canonical(line)))
    out = {}
    for field, value in expected.items():
        value, best = value.strip(), (0.0, "", "none")
        for _, _, t, n in sorted(x for x in found if x[3]) if value else ():
            score, how = scored(KINDS[field], value, t, n)
            if score > best[0] + 1e-12:
                best = (score, t, how)
        out[field] = (value, best[1], round(best[0], 9), best[2])
    return out


def portrait(doc_id, text, width=600, height=800):
    """(left of the face, top of the portrait, score) of the best of a page's three faces."""
    boxes = [x[3:] for x in words(text)]
    even = lambda x: int(np.rint(x))
    doc = None
    if boxes:
        a, b, c, d = min(x[0] for x in boxes), min(x[1] for x in boxes), max(x[2] for x in boxes), max(x[3] for x in boxes)
        w, h = max(1.0, c - a), max(1.0, d - b)
        a, b, c, d = max(0, even(a - w * 0.12)), max(0, even(b - h * 0.1)), min(width, even(c + w * 0.08)), min(height, even(d + h * 0.12))
        doc = (a, b, c, d) if c > a and d > b else None

    def penalty(box):
        hits = [(min(box[2], x[2]) - max(box[0], x[0])) * (min(box[3], x[3]) - max(box[1], x[1])) for x in boxes if min(box[2], x[2]) > max(box[0], x[0]) and min(box[3], x[3]) > max(box[1], x[1])]
        whole = max(1.0, max(0, box[2] - box[0]) * max(0, box[3] - box[1]))
        return min(len(hits) * 0.55 + sum(hits) / whole * 18.0, 7.5)

    side = None
    if doc:
        dw, dh = doc[2] - doc[0], doc[3] - doc[1]
        top, bottom, wide = doc[1] + even(dh * 0.2), min(doc[3], doc[1] + even(dh * 0.82)), even(dw * 0.36)
        left, right = penalty((doc[0], top, doc[0] + wide, bottom)), penalty((max(doc[0], doc[2] - wide), top, doc[2], bottom))
        side = None if abs(left - right) < 0.6 else "left" if left < right else "right"
    best, inside_any, faces = None, False, []
    for order, x in enumerate((30, 260, 480)):
        y, w, h = 100 + doc_id % 300, 60 + doc_id % 40, 70 + doc_id % 40
        cx, cy = x + w / 2.0, y + h / 2.0
        rx, ry = ((cx - doc[0]) / max(1.0, dw), (cy - doc[1]) / max(1.0, dh)) if doc else (None, None)
        inside = not doc or (doc[0] <= cx <= doc[2] and doc[1] <= cy <= doc[3] and 0.04 <= rx <= 0.96 and 0.22 <= ry <= 0.9 and (rx <= 0.42 or rx >= 0.58))
        a, b, c, d = max(0, even(x - w * 0.18)), max(0, even(y - h * 0.40)), min(width, even(x + w + w * 0.18)), min(height, even(y + h + h * 0.42))
        score = min(w * h / (width * height) * 28.0, 6.0) + (1.4 if cx / width <= 0.42 or cx / width >= 0.58 else -1.5) + (1.0 if 0.18 <= cy / height <= 0.72 else -0.8)
        if doc:
            area = w * h / max(1.0, dw * dh)
            score += 3.4 if 0.26 <= ry <= 0.78 else -min(abs(ry - 0.52) * 10.0, 5.2)
            score += 2.4 if rx <= 0.34 or rx >= 0.66 else -min(abs(rx - 0.5) * 6.0, 2.6)
            score += 1.6 if 0.012 <= area <= 0.085 else -min(abs(area - 0.038) * 36.0, 3.4)
            if side:
                score += 2.6 if ("left" if rx <= 0.5 else "right") == side else -0.9
        score += min(100 / 120.0, 2.5) + min(20 / 35.0, 1.5) - abs(1.0 - w / h) * 0.6 - penalty((a, b, c, d))
        faces.append((inside, order, x, b, score))
        inside_any = inside_any or inside
    faces = [f for f in faces if f[0] or not inside_any]
    # All faces of these pages are equally large, so none has a bonus for that but where there is no document.
    best = max(faces, key=lambda f: (f[4], -f[1]))
    bonus = 0.4 if len(faces) > 1 and doc is None else 0.0
    return best[2], best[3], round(best[4] + bonus, 6)
