"""Sources behind a service on this machine: posted texts, checked answers; nothing is followed elsewhere.

Off by default: a caller gives the address.  Workers call it, so on a cluster each
machine needs its own.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from urllib.parse import urlsplit


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        raise ValueError(f"the service points to {newurl}")


def post(url: str, body: dict, most: int = 8 << 20, seconds: float = 30.0) -> object:
    """The JSON answer of a loopback service; other hosts, redirects and answers beyond a size are errors."""
    if urlsplit(url).hostname not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError(f"{url} is no loopback address")
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.build_opener(_Stay).open(request, timeout=seconds) as answer:
        data = answer.read(most + 1)
    if len(data) > most:
        raise ValueError(f"an answer of more than {most} bytes")
    return json.loads(data)


def warnings_of(text: str, answer: object) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, rule, replacements) of a checker's answer; each must lie inside the text, in order and without overlap."""
    if not isinstance(answer, dict) or not isinstance(answer.get("matches"), list):
        raise ValueError("no list of matches")
    out, at = [], 0
    for m in sorted(answer["matches"], key=lambda m: m["offset"]):
        start, end = int(m["offset"]), int(m["offset"]) + int(m["length"])
        if not (0 <= start <= end <= len(text)) or start < at:
            raise ValueError(f"a match at {start} to {end} of {len(text)} characters")
        out.append((start, end, str(m["rule"]), [str(r) for r in m.get("replacements", [])]))
        at = end
    return out


def grammar_checker(url: str) -> Callable[[str], list[tuple[int, int, str, list[str]]]]:
    return lambda text: warnings_of(text, post(url, {"text": text}))


def simplifier(url: str) -> Callable[[str], str]:
    """A system that asks a service; an answer without an output is an error."""

    def ask(text: str) -> str:
        answer = post(url, {"text": text})
        if not isinstance(answer, dict) or not isinstance(answer.get("output"), str):
            raise ValueError("no output")
        return answer["output"]

    return ask
