"""Errors that say what went wrong, why, and what to do."""

from __future__ import annotations

import re

from loadscope.functions.text import CONTROL


class AnalysisError(Exception):
    """Every part is one line of at most 400 characters without control characters."""

    def __init__(self, code: str, what: str, why: str = "", fix: str = "", detail: str = ""):
        clean = lambda s: " ".join(re.sub(CONTROL, "�", s).split())[:400]
        self.code, self.what, self.why, self.fix, self.detail = code, clean(what), clean(why), clean(fix), clean(detail)
        super().__init__(" ".join(x for x in (self.what, self.why, self.fix, self.detail) if x))
