"""Files fetched ahead of a build, on the driver: cache, retries, mirrors. The engine itself reads files only."""

from __future__ import annotations

import os
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path

LEAST_BYTES = 1000


def _open(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as response:  # noqa: S310
        return response.read()


def mirrored(url: str, mirrors: dict[str, list[str]]) -> list[str]:
    """The URL, then the same path under each mirror of its prefix."""
    return [url] + [other + url.removeprefix(prefix) for prefix, others in mirrors.items() if url.startswith(prefix) for other in others]


def fetched(url: str, to: str, retries: int = 3, required: bool = True, mirrors: dict[str, list[str]] | None = None, read: Callable[[str], bytes] = _open, pause: float = 1.0) -> str | None:
    """Path of the file; one already there of some size is kept. A source that isn't required and can't be had gives None."""
    place = Path(to)
    if place.exists() and place.stat().st_size > LEAST_BYTES:
        return to
    error: Exception | None = None
    for turn in range(retries):
        for source in mirrored(url, mirrors or {}):
            try:
                body = read(source)
            except OSError as e:
                error = e
                continue
            place.parent.mkdir(parents=True, exist_ok=True)
            part = place.with_suffix(place.suffix + ".part")
            part.write_bytes(body)
            os.replace(part, place)
            return to
        time.sleep(pause * (turn + 1))
    if required:
        raise RuntimeError(f"can't fetch {url}") from error
    return None


def source_list(templates: dict[str, str], languages: dict[str, dict], folder: str) -> list[tuple[str, str, bool]]:
    """(url, path, required) of all files of a build: for each language its editions' URLs from the template of their kind.

    `languages`: lang -> {"kind": template's name, "editions": [...], "required": bool}. Templates have {edition} and {lang}.
    """
    out = []
    for lang, of in languages.items():
        for edition in of["editions"]:
            url = templates[of["kind"]].format(edition=edition, lang=lang)
            out.append((url, f"{folder}/{of['kind']}-{lang}-{edition}.json", bool(of.get("required", False))))
    return out


def fetched_all(sources: list[tuple[str, str, bool]], progress: Callable[[str, int, int], None] | None = None, **how) -> list[str]:
    """Fetches a source list; paths of what is there. An optional source that can't be had is left out, a required one raises."""
    got = []
    for k, (url, to, required) in enumerate(sources):
        path = fetched(url, to, required=required, **how)
        got += [path] if path else []
        if progress:
            progress("fetch", k + 1, len(sources))
    return got


def paged(url_of: Callable[[int], str], pages: range, rows_of: Callable[[bytes], list[dict]], retries: int = 4, pause: float = 0.15, read: Callable[[str], bytes] = _open, wait: Callable[[float], None] = time.sleep) -> list[dict]:
    """All rows of a REST source in pages, one request after the other with a pause between; a page that fails is tried again, with
    longer and longer waits, and raises in the end."""
    out: list[dict] = []
    for number in pages:
        for turn in range(retries):
            try:
                out += rows_of(read(url_of(number)))
                break
            except (OSError, ValueError):
                if turn == retries - 1:
                    raise
                wait(2.0 * (turn + 1))
        wait(pause)
    return out
