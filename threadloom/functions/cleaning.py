"""Cleaning of message bodies: boilerplate and quotation rules over the ordered lines of one message.

Every line is classified once, as one letter, so a message is a short string; the rules are patterns over that string.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import types as T

from .rows import per_row
from .text import FORWARDED, LEAD_MARKS, QUOTED_LINE, SAID

# Line patterns and limits.
RULE_LINE = re.compile(r"_{20,}\s*$")
HEADER = re.compile(r"\s*(From|Sent|To|Cc|Subject|Date)\s*:", re.I)
SIGNATURE = "-- "
LOOKAHEAD, THIN_CHARS, CONTEXT_LINES, ATTRIBUTION_CHARS = 3, 200, 15, 200
COUNTERS = ("footer", "outlook_separator", "original_message", "signature", "sig_block", "single_block_quote", "interleaved_kept", "attribution", "thin_reply_context")

MARKS = re.compile(LEAD_MARKS)
QUOTED = re.compile(QUOTED_LINE)
ORIGINAL = re.compile(rf"(?i:{FORWARDED})\s*-{{2,}}\s*$")
ATTRIBUTION = re.compile(rf"(?is)(?=.{{1,{ATTRIBUTION_CHARS}}}$)(?:.*{FORWARDED}|.*{SAID}.*(?<=:)$)")


def _near(texts: list[str], at: int, meets) -> bool:
    """Whether one of the next lines that aren't blank meets a condition."""
    return any(t and meets(t) for t in texts[at + 1 : at + 2 + LOOKAHEAD])


def _boilerplate_letters(lines: list[str], marker: str) -> str:
    """F and f: a footer's first line, and one that goes on with it (the capital or i, j where it could start a new one);
    S, s: a rule above headers, and one above anything else; O: an original-message rule; -: a signature; b: blank; t: text."""
    depths = [sum(map(MARKS.match(x)[0].count, ">|")) if MARKS.match(x) else 0 for x in lines]
    texts = [MARKS.sub("", x).strip() for x in lines]
    tag, out = marker.lower(), []
    for at, (line, text) in enumerate(zip(lines, texts, strict=True)):
        rule, low = bool(RULE_LINE.match(text)), text.lower()
        goes_on = at > 0 and depths[at] == depths[at - 1] and bool(text) and (rule or tag in low or "@" in text or low.startswith("http"))
        if rule and _near(texts, at, lambda t: tag in t.lower()):
            out.append("i" if goes_on else "F")
        elif rule and depths[at] == 0:
            above_headers = _near(texts, at, HEADER.match)
            out.append(("j" if above_headers else "k") if goes_on else ("S" if above_headers else "s"))
        elif ORIGINAL.match(text):
            out.append("O")
        else:
            out.append("-" if line == SIGNATURE else "f" if goes_on else "t" if line.strip() else "b")
    return "".join(out)


def strip_boilerplate(lines: list[str], marker: str) -> tuple[list[str], dict[str, int]]:
    """Drops list footers at any depth, and everything from a forwarded header, an original-message rule or a signature on.

    All but the signature must leave something that isn't blank before them. Only the first place of these rules can: what
    stands before a later one begins with a place that was spared, and does not count.
    """
    kinds, counts = _boilerplate_letters(lines, marker), {}
    letters = re.sub("[Fi][fijk]*", lambda m: "x" * len(m[0]), kinds)
    place, end = re.search("[SsjkO]", letters), letters.find("-") % (len(lines) + 1)
    if place and place.start() < end and any(x.strip() for x, k in zip(lines, letters[: place.start()], strict=False) if k != "x"):
        end = place.start()
        counts[{"S": "outlook_separator", "j": "outlook_separator", "O": "original_message"}.get(place[0], "sig_block")] = 1
    elif end < len(lines):
        counts["signature"] = 1
    if footers := len(re.findall("[Fi][fijk]*", kinds[:end])):
        counts["footer"] = footers
    return [x for x, k in zip(lines, letters[:end], strict=False) if k != "x"], counts


def is_attribution(line: str) -> bool:
    return bool(ATTRIBUTION.match(line.strip()))


def apply_quotes(lines: list[str], thin: int = THIN_CHARS, context: int = CONTEXT_LINES) -> tuple[list[str], list[tuple[int, int]], dict[str, int]]:
    """One block of quoted lines is dropped (a thin reply keeps its first lines as context); of several, all stay and are marked.

    Letters: q quoted, a attribution, b blank, t other text.
    """
    letters = "".join("q" if QUOTED.match(x) else "b" if not x.strip() else "a" if is_attribution(x) else "t" for x in lines)
    of = lambda kinds: [x for x, k in zip(lines, letters, strict=True) if k in kinds]
    marked = lambda x: "| " + QUOTED.sub("", x).strip()
    blocks = len(re.findall("q+", letters.replace("b", "")))
    if not blocks:
        return list(lines), [], {}
    counts = {"attribution": letters.count("a")}
    if blocks > 1:
        place = [0, *accumulate(int(k != "a") for k in letters)]
        kept = [marked(x) if k == "q" else x for x, k in zip(lines, letters, strict=True) if k != "a"]
        return kept, [(place[m.start()], place[m.end()] - 1) for m in re.finditer("q+", letters)], counts | {"interleaved_kept": 1}
    own, kinds = of("bt"), letters.replace("q", "").replace("a", "")
    own = own[len(kinds) - len(kinds.lstrip("b")) : len(kinds.rstrip("b"))]
    counts["single_block_quote"] = 1
    if len("".join(map(str.strip, own))) >= thin:
        return own, [], counts
    head = list(map(marked, of("q")[:context]))
    return [*head, *[""][: len(own)], *own], [(0, len(head) - 1)], counts | {"thin_reply_context": 1}


def clean_body(text: str, marker: str) -> dict:
    kept, counts = strip_boilerplate((text or "").replace("\r", "").split("\n"), marker)
    lines, spans, more = apply_quotes(kept)
    quoted = [MARKS.sub("", x) for x in kept if x.lstrip().startswith(">")]
    counts |= more
    return {"body": "\n".join(lines).strip(), "quoted": "\n".join(quoted).lower(), "quote_spans": [list(s) for s in spans], "stripped": {k: int(counts.get(k, 0)) for k in COUNTERS}}


CLEANED = T.StructType().add("body", "string").add("quoted", "string").add("quote_spans", T.ArrayType(T.ArrayType(T.IntegerType()))).add("stripped", T.MapType(T.StringType(), T.IntegerType()))


def clean_body_udf(marker: str):
    return per_row(lambda text: clean_body(text, marker), CLEANED)
