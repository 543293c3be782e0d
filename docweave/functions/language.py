"""What language a code block without a label is in, by weighted signals; the same table serves Python and SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (weight, pattern); strong signals weigh 2 and suffice alone.  The patterns use what Python, Java and RE2 share.
SIGNALS = {
    "python": [
        (2, r"(?m)^[ \t]*def[ \t]+\w+[ \t]*\("),
        (2, r"(?m)^[ \t]*class[ \t]+\w+[ \t]*[(:]"),
        (2, r"(?m)^[ \t]*(?:from[ \t]+[.\w]+[ \t]+import\b|import[ \t]+\w)"),
        (2, r"->[ \t]*(?:[A-Z]\w*|None|bool|dict|float|int|list|str)[ \t]*:"),
        (1, r"(?m)^[ \t]*return\b"),
        (1, r"\bself\."),
        (1, r":[ \t]*(?:bool|dict|float|int|list|set|str|tuple)\["),
        (1, r"\bf(?:\"[^\"]*\{|'[^']*\{)"),
        (1, r"\bprint\("),
        (1, r"(?m)^[ \t]*(?:elif|else|except|for|if|try|while|with)\b.*:[ \t]*$"),
    ],
    "javascript": [
        (2, r"\b(?:const|let|var)[ \t]+\w+[ \t]*="),
        (2, r"\bfunction[ \t]*\*?[ \t]*\w*[ \t]*\("),
        (1, r"=>"),
        (1, r"\bexport[ \t]+(?:const|default|function)\b|\brequire\("),
        (1, r"\bconsole\.\w+\("),
    ],
    "powershell": [(2, r"(?i)\$env:\w+"), (2, r"(?s)@\".*?\"@"), (2, r"\b(?:Get|Set)-\w+\b|\bWrite-(?:Host|Output)\b"), (1, r"\$_\.|\$PSItem\b")],
    "bash": [
        (2, r"(?m)^[ \t]*#!.*\b(?:ba)?sh\b"),
        (2, r"(?m)^[ \t]*\$[ \t]+[^ \t\n]"),
        (1, r"(?m)^[ \t]*pytest\b|\bpip[ \t]+install\b|\bpython[ \t]+-m\b"),
        (1, r"(?m)^[ \t]*(?:apt|cd|cp|curl|echo|export|git|mkdir|mv|npm|npx|rm|sudo)\b"),
        (1, r"\|[ \t]*(?:awk|grep|jq|sed|xargs)\b"),
    ],
}
JSON_EDGE, JSON_KEY, JSON_NOT = r"(?s)^[ \t\n\r]*[{\[].*[}\]][ \t\n\r]*$", r"\"[^\"]+\"[ \t\n\r]*:", r"\b(?:const|def|function|import|let|return|var)\b|#|//|=>"


def guess(code: str) -> str | None:
    if not code.strip():
        return None
    if re.search(JSON_EDGE, code) and re.search(JSON_KEY, code) and not re.search(JSON_NOT, code):
        return "json"
    score = {k: sum(w for w, rx in own if re.search(rx, code)) for k, own in SIGNALS.items()}
    if score["powershell"] >= 2:
        score["bash"] = 0
    top = max(score.values())
    best = [k for k, v in score.items() if v == top]
    return best[0] if top >= 2 and len(best) == 1 else None


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def guessed(code: Column) -> Column:
    """The same as a native expression; null where it isn't sure.  Every pattern is tried once."""
    scores = F.struct(*(sum((F.when(code.rlike(rx), w).otherwise(0) for w, rx in own), F.lit(0)).alias(k) for k, own in SIGNALS.items()))

    def best(s: Column) -> Column:
        bash = F.when(s["powershell"] >= 2, 0).otherwise(s["bash"])
        return _bound(F.struct(*(s[k].alias(k) for k in SIGNALS if k != "bash"), bash.alias("bash")), choose)

    def choose(s: Column) -> Column:
        top = F.greatest(*(s[k] for k in SIGNALS))
        ties = sum((F.when(s[k] == top, 1).otherwise(0) for k in SIGNALS), F.lit(0))
        out = F.when((top < 2) | (ties != 1), F.lit(None).cast("string"))
        for k in SIGNALS:
            out = out.when(s[k] == top, k)
        return out

    return F.when(code.rlike(JSON_EDGE) & code.rlike(JSON_KEY) & ~code.rlike(JSON_NOT), "json").otherwise(_bound(scores, best))


def sql(code: str) -> str:
    """DuckDB text of the same expression."""
    q = lambda rx: "'" + rx.replace("'", "''") + "'"
    hit = lambda rx: f"regexp_matches({code}, {q(rx)})"
    s = {k: "(" + " + ".join(f"case when {hit(rx)} then {w} else 0 end" for w, rx in own) + ")" for k, own in SIGNALS.items()}
    s["bash"] = f"(case when {s['powershell']} >= 2 then 0 else {s['bash']} end)"
    top = f"greatest({', '.join(s.values())})"
    ties = " + ".join(f"case when {v} = {top} then 1 else 0 end" for v in s.values())
    cases = " ".join(f"when {top} >= 2 and ({ties}) = 1 and {v} = {top} then '{k}'" for k, v in s.items())
    return f"case when {hit(JSON_EDGE)} and {hit(JSON_KEY)} and not {hit(JSON_NOT)} then 'json' {cases} end"
