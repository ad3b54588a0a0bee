"""A self-contained HTML page: no network, a strict content policy, data as base64 JSON."""

from __future__ import annotations

import base64
import html
import json
import re
import secrets
from pathlib import Path
from typing import Any

THEMES = ("default", "ydata-like")
FOLDER = Path(__file__).resolve().parent / "templates"


def template(theme: str) -> str:
    """The page without data. Themes share their script; each has a style sheet, and with it a layout, of its own."""
    if theme not in THEMES:
        raise ValueError(f"unknown theme {theme!r}; choose from {', '.join(THEMES)}")
    text = (FOLDER / "default.html").read_text(encoding="utf-8")
    if theme == "default":
        return text
    path = (FOLDER / f"{theme}.css").resolve()
    if FOLDER not in path.parents:  # never leave the folder, whatever the name
        raise ValueError(f"unknown theme {theme!r}")
    head, rest = text.split("<style", 1)
    opening, rest = rest.split(">", 1)
    own, rest = rest.split("</style>", 1)
    scale = "\n".join(line for line in own.splitlines() if line.startswith(".s"))  # the colours of matrices
    return f"{head}<style{opening}>\n{path.read_text(encoding='utf-8')}{scale}\n</style>{rest}"


def page(report: dict[str, Any], theme: str = "default", minify: bool = True, offline: bool = True) -> str:
    """The page of a report's dict. Both modes are self-contained; ``offline`` is kept for callers."""
    nonce = secrets.token_urlsafe(16)
    policy = f"default-src 'none'; script-src 'nonce-{nonce}'; style-src 'nonce-{nonce}'; img-src data:; base-uri 'none'; form-action 'none'"
    text = template(theme)
    if minify:
        text = re.sub(r"\n\s+", "\n", text)
    payload = base64.b64encode(json.dumps(report, ensure_ascii=False).encode()).decode()
    title = html.escape(str(report.get("analysis", {}).get("title", "")))
    for mark, value in (("{{CSP_META}}", f'<meta http-equiv="Content-Security-Policy" content="{policy}">'), ("{{NONCE}}", nonce), ("{{TITLE}}", title), ("{{DATA}}", payload)):
        text = text.replace(mark, value)
    return text
