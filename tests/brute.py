"""Plain, slow versions of the operators to compare with on small inputs."""

from __future__ import annotations

import re

from tuturan.functions.numbers import malay_table

WORD = re.compile(r"\w")
SPELLED = malay_table()


def malay(n: int) -> str:
    if n == 0:
        return "kosong"
    for size, single, unit in ((10**9, "satu bilion", "bilion"), (10**6, "sejuta", "juta"), (1000, "seribu", "ribu")):
        head, rest = divmod(n, size)
        if head:
            spoken = single if head == 1 else f"{malay(head)} {unit}"
            return f"{spoken} {malay(rest)}" if rest else spoken
    return SPELLED[n]


def malay_numbers(text: str) -> str:
    """Numbers of a text in Malay words."""
    if not text.strip():
        return text

    def decimals(part: str) -> str:
        return " perpuluhan " + " ".join(malay(int(c)) for c in part) if part else ""

    def money(m):
        whole, _, cents = m[1].replace(",", "").partition(".")
        tail = f" {malay(int(cents))} sen" if cents.strip("0") else ""
        return malay(int(whole)) + " ringgit" + tail

    def percent(m):
        whole, _, part = m[1].partition(".")
        return malay(int(whole)) + (decimals(part) if part.strip("0") else "") + " peratus"

    def plain(m):
        whole, _, part = m[1].replace(",", "").partition(".")
        return malay(int(whole)) + decimals(part)

    text = re.sub(r"RM\s*([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?|[0-9]+(?:\.[0-9]{2})?)", money, text)
    text = re.sub(r"([0-9]+(?:\.[0-9]+)?)\s*%", percent, text)
    text = re.sub(r"\b([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\b", plain, text)
    return " ".join(text.split())


def ordered_fold(text: str, pairs) -> str:
    for pattern, to in pairs:
        text = re.sub(pattern, to, text, flags=re.IGNORECASE)
    return text


def looping(text: str) -> tuple[str, bool]:
    """First loop of a text by trying every place; six rules, the first that fires wins."""

    def times(seq, at, size):
        n = 0
        while seq[at + n * size : at + (n + 1) * size] == seq[at : at + size] and at + (n + 1) * size <= len(seq):
            n += 1
        return n

    for at in range(len(text) if len(text) > 20 else 0):
        if times(text, at, 1) > 10 and (ord(text[at]) > 127 or text[at] in "aeiou."):
            return text[:at].strip() or text[at], True
    for size in (1, 2, 3, 4):
        for at in range(len(text)):
            if times(text, at, size) > 10:
                return text[:at].strip() or text[at : at + size], True
    found = re.search(r"\b(\w{1,5})\b(?:,\s*\1){5,}", text)
    if found:
        return text[: text.index(found[1] + ",")].strip() or found[1], True
    words = text.split()
    for at in range(len(words) if len(words) > 3 else 0):
        for size in range(1, 10):
            if times(words, at, size) > 3:
                return " ".join(words[: at + size]), True
    plain = [re.sub(r"[^\w\s]", "", w.lower()) for w in words]
    for at in range(len(words) if len(words) > 5 else 0):
        if plain[at] and times(plain, at, 1) > 6:
            return " ".join(words[: at + 1]), True
    dots = re.search(r"\.{10,}", text)
    if text.count(".") > 10 and dots:
        return text[: dots.start()].strip(), True
    return text, False


def edit_cost(ref: list[str], hyp: list[str]) -> tuple[int, int]:
    """(distance, fewest substitutions among the best alignments)."""
    rows = [[(j, 0) for j in range(len(hyp) + 1)]]
    for i, r in enumerate(ref, 1):
        row = [(i, 0)]
        for j, h in enumerate(hyp, 1):
            d, s = rows[-1][j - 1]
            options = [(d, s) if r == h else (d + 1, s + 1)]
            options += [(d + 1, s) for d, s in (rows[-1][j], row[j - 1])]
            row.append(min(options))
        rows.append(row)
    return rows[-1][-1]
