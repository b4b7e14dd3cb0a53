"""Records from a language model's answers, off unless asked for. What is called is a function of a message; `local_model` makes one for a model served on this machine."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from provspark.functions import text
from provspark.operators.records import RECORD

MOST_CONFIDENCE = 0.7
LOCAL = "http://localhost:11434"
ASKED = """A commit message follows. If it tells a design decision, answer with one JSON object and nothing else: {"content": what was decided, "reason": why, "alternatives": [what was turned down], "confidence": 0 to 1}.
If it tells none, answer {}.

"""
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def parse_answer(answer: str | None, source_ref: str, file_path: str = "") -> dict | None:
    """A model's JSON answer as a record; None where it isn't JSON or says no content. A missing reason is the content itself, so such records are decisions."""
    m = re.search(r"\{.*\}", answer or "", re.S)
    try:
        said = json.loads(m[0]) if m else None
    except ValueError:
        return None
    if not isinstance(said, dict) or not str(said.get("content") or "").strip():
        return None
    content = str(said["content"]).strip()[: text.CONTENT_MOST]
    try:
        confidence = min(MOST_CONFIDENCE, max(0.0, float(said.get("confidence", MOST_CONFIDENCE))))
    except (TypeError, ValueError):
        confidence = MOST_CONFIDENCE
    others = said.get("alternatives")
    return {
        "uid": f"{file_path or source_ref}::decision::llm@1::{text.fingerprint(content)}", "content": content, "reason": str(said.get("reason") or content)[: text.REASON_MOST],
        "alternatives": [str(x)[: text.ALTERNATIVE_MOST] for x in others] if isinstance(others, list) else [], "status": "accepted", "source": "commit", "source_ref": source_ref, "file_path": file_path,
        "confidence": confidence, "category": "design", "tier": "decision",
    }


def enriched(messages: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """Records for messages (seq, sha, message, file_path) of which no line gives a reason; ask: message -> answer, called by tasks."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for seq, sha, message, path in zip(f["seq"], f["sha"], f["message"], f["file_path"], strict=True):
                if not any(text.says_decision(line) for line in (message or "").splitlines()):
                    r = parse_answer(ask(message or ""), f"commit {sha}", path or "")
                    rows += [{"seq": seq, "nth": 0, **r}] if r else []
            yield pd.DataFrame(rows, columns=["seq", "nth", *NAMES])

    return messages.select("seq", "sha", "message", "file_path").mapInPandas(work, f"seq long, nth int, {RECORD}")


def local_model(name: str, url: str = LOCAL, seconds: float = 60.0) -> Callable[[str], str]:
    """message -> answer of a model behind the usual local HTTP interface (POST /api/generate). Where nothing answers, the answer is empty and the rules stand alone."""

    def ask(message: str) -> str:
        body = json.dumps({"model": name, "prompt": ASKED + message, "stream": False}).encode()
        asked = urllib.request.Request(f"{url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(asked, timeout=seconds) as answer:
                return str(json.load(answer).get("response") or "")
        except (urllib.error.URLError, TimeoutError, ValueError, AttributeError):
            return ""

    return ask
