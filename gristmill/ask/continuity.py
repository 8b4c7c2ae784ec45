"""Questions that lean on the one before: a subject left unsaid, or doubt about an answer."""

from __future__ import annotations

import re

from gristmill.functions.text import CODE_SHAPE
from gristmill.plans.ir import Plan

# Parts of column names whose values can be what a conversation is about; words
# that point back at a subject.
SUBJECT_COLUMNS = ("name", "company", "customer", "client", "supplier", "vendor", "bank", "account", "entity", "partner", "counterparty", "branch", "plant", "site", "debtor", "creditor", "επωνυμ", "ονομα", "πελατ", "προμηθευτ", "τραπεζ")
POINTING = re.compile(r"\b(?:what about|how about|and (?:for )?(?:this|that|them|it|those)|same (?:for|question for)|for (?:this|that|it|them|those)(?: one)?|and (?:their|its|the))\b", re.I)
BARE = re.compile(r"(?:what about|how about|and)\s+(?:this|that|them|it|those)(?: one)?", re.I)
# Words that ask to confirm an answer; words that take something out of a result, and a place in it.
DOUBT = re.compile(r"\b(?:are (?:you|u) sure|sure about (?:that|this|it)|is (?:that|this|it) (?:correct|right|accurate|true)|double.?check|verify (?:that|this|it)|can you confirm|prove it|how did you get)\b|\breally\?", re.I)
TAKE_OUT = re.compile(r"\b(?:delete|remove|drop|hide|exclude|omit|strike|take out|leave out|get rid of)\b", re.I)
PLACE = re.compile(r"\b(?:first|second|third|last|final|top|bottom|\d+(?:st|nd|rd|th))\s+(?:\w+\s+)?(?:row|line|record|entry|entries|result)s?\b|\b(?:row|line)s?\s+(?:number\s+)?\d+\b", re.I)


def subject_of(plan: Plan | None) -> str:
    """The text value that a plan filters on by equality: one of a column of names before any other."""
    found = ""
    for f in plan.filters if plan else []:
        value = f.value[0] if isinstance(f.value, list) and len(f.value) == 1 else f.value
        if f.op in ("eq", "match") and isinstance(value, str) and re.search(r"[^\d\s.,:/-]", value):
            if any(w in f.column.lower() for w in SUBJECT_COLUMNS):
                return value.strip()
            found = found or value.strip()
    return found


def carries_over(question: str, subject: str) -> bool:
    """Whether a question points back at a subject that it does not name, and names no other by a code."""
    return bool(subject) and subject.lower() not in question.lower() and not re.search(rf"\b{CODE_SHAPE}\b", question) and bool(POINTING.search(question))


def with_subject(question: str, last: str, subject: str) -> str:
    """The question with its subject said: the last one again if it asks for nothing new."""
    asked = question.strip().rstrip("?").strip()
    if BARE.fullmatch(asked) and last:
        return last if subject.lower() in last.lower() else f"{last.rstrip('? ')} for {subject}"
    asked = re.sub(r"^(?:and|what about|how about)\s+", "", asked, flags=re.I)
    asked = re.sub(r"\b(?:for )?(?:their|its|this|that|them|it|those)(?: one)?\b", " ", asked, flags=re.I)
    return f"{' '.join(asked.split())} for {subject}"


def in_doubt(question: str) -> bool:
    return bool(DOUBT.search(question))


def edits_by_place(question: str) -> bool:
    """Whether rows of the last answer are to be taken out by where they stand; "the total row" names a value."""
    return bool(TAKE_OUT.search(question)) and bool(PLACE.search(question))
