"""Mathematical formulas in text: LaTeX marks and runs of mathematical characters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, sub, swap

# LaTeX marks in the order they are tried, and what characters stand for.
LATEX = (
    r"\$\$([^$]+)\$\$", r"\$([^$]+)\$", r"\\\[([\s\S]*?)\\\]", r"\\\( ([\s\S]*?)\\\)",
    r"\\begin\{equation\}([\s\S]*?)\\end\{equation\}", r"\\begin\{align\}([\s\S]*?)\\end\{align\}", r"\\begin\{gather\}([\s\S]*?)\\end\{gather\}",
)
MATH = "\u2200-\u22ff\u2150-\u217f\u2070-\u209f\U0001d400-\U0001d7ff\u0370-\u03ff"
SYMBOLS = {
    "∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∂": "\\partial", "√": "\\sqrt", "∞": "\\infty", "≠": "\\neq", "≤": "\\leq", "≥": "\\geq", "≈": "\\approx",
    "∈": "\\in", "∉": "\\notin", "⊂": "\\subset", "⊃": "\\supset", "∪": "\\cup", "∩": "\\cap", "∧": "\\wedge", "∨": "\\vee", "¬": "\\neg",
    "→": "\\rightarrow", "←": "\\leftarrow", "↔": "\\leftrightarrow", "⇒": "\\Rightarrow", "⇐": "\\Leftarrow", "⇔": "\\Leftrightarrow",
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\epsilon", "ζ": "\\zeta", "η": "\\eta", "θ": "\\theta", "ι": "\\iota",
    "κ": "\\kappa", "λ": "\\lambda", "μ": "\\mu", "ν": "\\nu", "ξ": "\\xi", "π": "\\pi", "ρ": "\\rho", "σ": "\\sigma", "τ": "\\tau", "υ": "\\upsilon",
    "φ": "\\phi", "χ": "\\chi", "ψ": "\\psi", "ω": "\\omega", "×": "\\times", "÷": "\\div", "±": "\\pm", "°": "^\\circ", "²": "^2", "³": "^3",
}
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
OPERATORS = ("sum", "prod", "int", "sqrt", "infty")
SCHEMA = "array<struct<latex:string,begin:int,end:int,confidence:double,type:string>>"


def find(text: str | None) -> list[dict]:
    """Formulas by LaTeX marks, then runs of three mathematical characters at least."""
    out = []
    for pattern in LATEX if text else ():
        for m in re.finditer(pattern, text):
            shown = m[0].startswith(("$$", "\\["))
            out.append({"latex": m[1].strip(), "begin": m.start(), "end": m.end(), "confidence": 0.95, "type": "display" if shown else "inline"})
    for m in re.finditer(f"[{MATH}]{{3,}}", text or ""):
        latex = "".join(SYMBOLS.get(c, c) for c in m[0])
        out.append({"latex": latex, "begin": m.start(), "end": m.end(), "confidence": 0.7, "type": "inline"})
    return out


def _formulas(texts: pd.Series) -> pd.Series:
    return texts.map(find)


def formulas(c: Column) -> Column:
    """Places need a scanner; texts without a mark should be filtered out first (see may_have)."""
    return F.pandas_udf(_formulas, SCHEMA)(c)


def may_have(c: Column) -> Column:
    return c.rlike(f"[$\\\\{MATH}]")


def placeholders(text: Column, found: Column) -> Column:
    """Text with each formula replaced, the last first; they are numbered from the end."""
    order = F.array_sort(
        F.transform(found, lambda f, i: F.struct((-f["begin"]).alias("from"), i.alias("i"), f["end"].alias("end"))),
    )
    return F.aggregate(
        order,
        F.struct(text.alias("t"), F.lit(0).alias("n")),
        lambda a, f: F.struct(
            F.concat(F.substring(a["t"], F.lit(1), -f["from"]), F.lit("<!-- FORMULA_"), a["n"].cast("string"), F.lit(" -->"), F.substring(a["t"], f["end"] + 1, F.length(a["t"]))).alias("t"),
            (a["n"] + 1).alias("n"),
        ),
        lambda a: a["t"],
    )


def mathml(c: Column) -> Column:
    """Simple LaTeX as MathML: fractions, powers, indices, Greek letters, five operators."""
    c = sub(c, r"\\frac\{([^}]+)\}\{([^}]+)\}", "<mfrac><mi>$1</mi><mi>$2</mi></mfrac>")
    c = sub(c, f"\\^([{WORD}]+)", "<msup><mi></mi><mi>$1</mi></msup>")
    c = sub(c, f"_\\{{?([{WORD}]+)\\}}?", "<msub><mi></mi><mi>$1</mi></msub>")
    letters = {v[1:]: k for k, v in SYMBOLS.items()}
    for name in GREEK:
        c = sub(c, f"\\\\{name}(?![{WORD}])", f"<mi>{letters[name]}</mi>")
    for name in OPERATORS:
        c = swap(c, f"\\{name}", f"<mo>{letters[name]}</mo>")
    return F.concat(F.lit('<math xmlns="http://www.w3.org/1998/Math/MathML">'), c, F.lit("</math>"))


def formula_html(latex: Column, kind: Column) -> Column:
    return F.when(kind == "display", F.concat(F.lit('<div class="math-display">'), mathml(latex), F.lit("</div>"))).otherwise(F.concat(F.lit('<span class="math-inline">'), mathml(latex), F.lit("</span>")))


