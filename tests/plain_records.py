"""Records of one text at a time in plain Python, which the column forms are held to."""

import re

from provspark.functions import text
from provspark.operators.records import changelog_items

#: A first word that is no name.
PLAIN_WORD = re.compile(r"[^\W\d_][^\s./_`-]*(\s|$)")


def unwrap(said: str | None) -> str:
    """Paragraphs on one line each; a blank line or a bullet begins a new one."""
    blocks: list[list[str]] = [[]]
    for line in map(str.strip, (said or "").splitlines()):
        if not line or re.match(r"[-*+]\s+", line):
            blocks.append([])
        if line:
            blocks[-1].append(line)
    return "\n\n".join(" ".join(b) for b in blocks if b)


def parts_of_commit(message: str | None) -> tuple[str, list[str]]:
    """(subject, what the body says, piece by piece)."""
    subject, _, body = (message or "").strip("\n").partition("\n")
    bullets = [b.strip() for b in re.findall(r"^\s*[-*+]\s+(.+)$", body, re.M) if b.strip()]
    return subject.strip(), bullets or text.sentences_of(unwrap(body))


def clean_clause(said: str | None) -> str:
    """A clause without an open bracket and without connecting words at its end; clean_clause_column says the same."""
    said = " ".join((said or "").split())
    open_, keep = 0, len(said)
    for at, c in enumerate(said):
        if c == "(":
            keep = at if open_ <= 0 else keep  # the last place up to which all brackets are closed
        open_ += (c == "(") - (c == ")")
    return re.sub(text.LOOSE_END, "", said[: keep if open_ > 0 else len(said)].rstrip(text.ENDINGS)).rstrip(text.ENDINGS)


def polish(said: str | None) -> str:
    """Content as a sentence: without a structural heading, capitalised unless it begins with a name; polish_column says the same."""
    said = clean_clause(re.sub(text.SECTION_HEAD, "", " ".join((said or "").split()).rstrip(text.ENDINGS)))
    return said[:1].upper() + said[1:] if PLAIN_WORD.match(said) and said.partition(" ")[0].islower() else said


def polish_alternative(said: str | None) -> str:
    return clean_clause(" ".join((said or "").split()).rstrip("."))


def is_usable(said: str | None) -> bool:
    """Whether content stands on its own: two words at least, no fragment, and three words, a verb of deciding or something like an identifier."""
    return re.match(text.USABLE, re.sub(text.ANY_HEAD, "", " ".join((said or "").split()).rstrip(text.ENDINGS))) is not None


def record(sentence: str, source: str, source_ref: str, file_path: str, prefix: str, confidence: float, category: str = "design", tier: str | None = None) -> dict | None:
    """One sentence as a record, none where a decision's content doesn't stand on its own."""
    raw, reason, alternatives = text.parts_of_sentence(sentence)
    content, reason = polish(raw), clean_clause(reason)
    alternatives = [polish_alternative(a) for a in alternatives if a.strip()]
    content = content if len(content) <= text.CONTENT_MOST else content[: text.CONTENT_MOST - 3] + "..."
    tier = tier or ("decision" if reason.strip() or alternatives else "event")
    if tier == "decision" and not is_usable(raw):
        return None
    uid = f"{file_path or source_ref}::decision::{prefix}@1::{text.fingerprint(content)}"
    return {"uid": uid, "content": content, "reason": reason, "alternatives": alternatives, "status": "accepted", "source": source, "source_ref": source_ref, "file_path": file_path, "confidence": confidence, "category": category, "tier": tier}


def _dependency(subject: str) -> bool:
    t = subject.strip()
    return bool(re.match(text.DEPENDENCY_START, t) or re.search(text.DEPENDENCY_BUMP, t))


def of_commit(message: str | None, source_ref: str, file_path: str = "") -> list[dict]:
    """The subject's record, then those of body parts that give a reason."""
    subject, parts = parts_of_commit(message)
    m = re.match(text.CONVENTIONAL, subject)
    said = (m[3] if m else subject).strip()
    out = []
    if said:
        dep = _dependency(subject) or _dependency(said)
        decided = any(text.parts_of_sentence(said)[1:])
        out.append(record(said, "commit", source_ref, file_path, "commit-subject", (0.65 if dep else 0.6) if decided else 0.5, "dependency" if dep else "design", "decision" if decided else "event"))
    for part in parts:
        if text.says_decision(part):
            decided = any(text.parts_of_sentence(part)[1:])
            out.append(record(part, "commit", source_ref, file_path, "commit-body", 0.7 if decided else 0.55, tier="decision" if decided else "event"))
    if re.match(r"Merge pull request #\d+", subject):
        out += of_text(message or "", "pr", source_ref, file_path, 0.65)
    return [r for r in out if r]


def of_text(said: str, source: str, source_ref: str, file_path: str = "", confidence: float = 0.55, category: str = "design") -> list[dict]:
    found = (record(s, source, source_ref, file_path, source, confidence, category) for s in text.sentences_of(said) if text.says_decision(s))
    return [r for r in found if r]


def of_changelog(said: str | None, name: str) -> list[dict]:
    return [r for title, b in changelog_items(said or "") for r in of_text(f"{title}: {b}", "comment", f"{name} · {title}", name, 0.6)]
