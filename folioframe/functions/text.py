"""Column expressions over a line's or block's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BULLETS = "\u2022\u2023\u25aa\u25cf\u25cb\u25a0\u25e6\u00b7\u2043\u2219*"
DASHES = "-\u2013\u2014"


def ascii_lower(c: Column) -> Column:
    """Only A to Z fold; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def segment_signature(c: Column, digits: bool = True) -> Column:
    """Text of a line for repetition tests: blanks dropped, ASCII folded, each run of digits one #."""
    plain = ascii_lower(F.replace(c, F.lit(" "), F.lit("")))
    return F.regexp_replace(plain, "#?[0-9]+", "#") if digits else plain


def block_signature(lines: Column) -> Column:
    return F.concat(F.array_join(F.transform(lines, lambda c: segment_signature(c)), "|"), F.lit("|"))


# Signatures of a block that holds only a page number, a line bar after each line; the last is a blank block.
PAGE_NUMBERS = ("#|", "-#-|", "page#|", "page#of#|", "#/#|", "[#]|", "|")
GREEK = "\u0391-\u03a9\u03b1-\u03c9\u03d1\u03d5\u03d6\u03f1\u03f5"


def is_page_number(c: Column) -> Column:
    return F.concat(segment_signature(c), F.lit("|")).isin(*PAGE_NUMBERS)


def is_citation_lead(c: Column) -> Column:
    return c.rlike(r"^ *\[[0-9]+\]")


def is_caption(c: Column) -> Column:
    return c.rlike("^ *(Figure|Table) [0-9]")


def heading_depth(c: Column) -> Column:
    """Parts of a leading dotted number that a space, a period or the end follows; else 0."""
    number = F.regexp_extract(c, r"^ *([0-9]+(?:\.[0-9]+)*)", 1)
    lead = F.length(F.regexp_extract(c, r"^( *[0-9]+(?:\.[0-9]+)*)", 1))
    after = F.substring(c, lead + 1, F.lit(1))
    return F.when((number != "") & after.isin(" ", ".", ""), F.size(F.split(number, r"\."))).otherwise(0)


def section_path(c: Column) -> Column:
    """The number of a numbered title, its appendix letter in front; a blank and a title must follow. Else empty."""
    return F.regexp_extract(c, r"^ *((?:[A-Z]\.)?[0-9]+(?:\.[0-9]+)*) +[^ ]", 1)


def section_depth(c: Column) -> Column:
    path = section_path(c)
    return F.when(path != "", F.size(F.split(path, r"\."))).otherwise(0)


def heading_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", " "))


def metadata_label(c: Column) -> Column:
    """The label before a field's colon, which a blank or the end follows: letters (Greek ones count, but aren't part of
    it), digits, blanks and - _ / ( ) & , of up to 40 characters, with a letter among them."""
    found, after = F.regexp_extract(c, "^ *([^:]*):", 1), F.regexp_extract(c, "^[^:]*:(.?)", 1)
    label = F.regexp_replace(found, f"[{GREEK}]", "")
    fits = c.contains(":") & after.isin("", " ") & found.rlike(f"^[A-Za-z0-9 _/()&,{GREEK}-]*$") & found.rlike(f"[A-Za-z{GREEK}]") & (F.length(label) <= 40)
    return F.when(fits, F.rtrim(label)).otherwise("")


def list_marker(c: Column) -> Column:
    """bullet, ordered, lettered or empty."""
    return (
        F.when(c.rlike(rf"^[{BULLETS}{DASHES[1:]}-] "), "bullet").when(c.rlike(r"^[0-9]{1,3}[.)] +"), "ordered").when(c.rlike(r"^([A-Za-z]|[ivxlcdmIVXLCDM]{1,6})\) "), "lettered").otherwise("")
    )


def strip_marker(c: Column) -> Column:
    """Bullets and numbers go; lettered markers stay in the text."""
    return F.regexp_replace(c, rf"^(?:[{BULLETS}{DASHES[1:]}-] +|[0-9]{{1,3}}[.)] +)", "")


def escape_inline(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\u00ad"), F.lit("")), r"([\\`*_\[<|~$])", r"\\$1")


def escape_line_start(c: Column) -> Column:
    c = F.regexp_replace(c, r"^([>+-])", r"\\$1")
    c = F.regexp_replace(c, r"^(#+)( |$)", r"\\$1$2")
    return F.regexp_replace(c, r"^([0-9]{1,9})([.)])( |$)", r"$1\\$2$3")


def code_span(c: Column) -> Column:
    """A delimiter one longer than the longest run of backticks; padded where an edge is a backtick or blank."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length)
    mark = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(c.rlike("^[` ]|[` ]$"), " ").otherwise("")
    return F.concat(mark, pad, c, pad, mark)


def gfm_cell(c: Column) -> Column:
    return F.trim(F.regexp_replace(escape_inline(c), " +", " "))


def gfm_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def yaml_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


def image_link(path: Column) -> Column:
    return F.concat(F.lit("![]("), F.when(path.rlike("[ ()]"), F.concat(F.lit("<"), path, F.lit(">"))).otherwise(path), F.lit(")"))


def display_math(lines: Column, tag: Column) -> Column:
    """Lines of a display formula, aligned where there are several; its number rides the last line."""
    numbered = F.when(F.coalesce(tag, F.lit("")) != "", F.concat(F.lit(" \\tag{"), tag, F.lit("}"))).otherwise("")
    body = F.concat(F.array_join(lines, " \\\\\n"), numbered)
    body = F.when(F.size(lines) > 1, F.concat(F.lit("\\begin{aligned}\n"), body, F.lit("\n\\end{aligned}"))).otherwise(body)
    return F.concat(F.lit("$$\n"), body, F.lit("\n$$"))


def script_braces(c: Column) -> Column:
    return F.when(F.length(c) == 1, c).otherwise(F.concat(F.lit("{"), c, F.lit("}")))


def starts_url(c: Column) -> Column:
    return c.rlike(r"^(www\.|[A-Za-z]{1,8}://)")


def url_wraps(head: Column, tail: Column) -> Column:
    """Whether a line's last word is a url (with :// anywhere, or www. in front) that runs on in the next line: that is no
    url itself, goes on with a sign of urls, and after anything but a separator not with a capital; the url doesn't end
    a sentence."""
    last = F.regexp_extract(head, "([^ ]*) *$", 1)
    url = last.contains("://") | last.rlike(r"^www\.")
    more = tail.rlike(r"^[A-Za-z0-9/.\-_~#?=&%+]") & ~(tail.rlike("^[A-Z]") & ~last.rlike(r"[/\-_.=?&#%+~]$"))
    return url & ~starts_url(tail) & ~last.rlike(r"[.!?,:;)]$") & more


def ligatures(c: Column) -> Column:
    """Latin ligatures as letters, private-use bullets as bullets, tabs as blanks."""
    for code, text in zip(range(0xFB00, 0xFB07), ("ff", "fi", "fl", "ffi", "ffl", "ft", "st")):
        c = F.replace(c, F.lit(chr(code)), F.lit(text))
    return F.translate(c, "\uf0b7\uf0a7\uf0d8\uf0fc\t", "\u2022\u25aa\u2023\u2713 ")


def font_style(name: Column, weight: Column) -> dict[str, Column]:
    bold = (weight >= 600) | name.rlike("(?i)bold|black|heavy|cmbx|cmbsy|cmmib")
    return {"bold": bold, "italic": name.rlike("(?i)italic|oblique"), "mono": name.rlike("(?i)courier|mono|consol")}


def is_cjk(code: Column) -> Column:
    return code.between(0x2E80, 0x9FFF) | code.between(0xF900, 0xFAFF) | code.between(0xFF00, 0xFFEF) | code.between(0xAC00, 0xD7AF) | code.between(0x20000, 0x2FA1F)


def is_space(code: Column) -> Column:
    """Blanks of all widths; the soft hyphen is none."""
    return code.isin(9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) | code.between(0x2000, 0x200A)


def render_run(text: Column, bold: Column, italic: Column, mono: Column, math: Column | None = None, raw: Column | None = None, strip: Column | None = None) -> Column:
    """Marks hug the trimmed text; blanks around it stay outside. Formulas stand between $, in bold where they are; raw text
    is left as it is. With `strip`, as in headings, styles go but formulas stay."""
    no = F.lit(False)
    math, raw, strip = (no if x is None else x for x in (math, raw, strip))
    inner = F.trim(text)
    mark = F.when(strip, "").when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    strong = F.when(~strip & bold, "**").otherwise("")
    lead, tail = F.regexp_extract(text, "^( *)", 1), F.regexp_extract(text, "( *)$", 1)
    body = F.when(math, F.concat(strong, F.lit("$"), inner, F.lit("$"), strong)).when(mono & ~strip, code_span(inner)).otherwise(F.concat(mark, escape_inline(inner), mark))
    return F.when(raw | (inner == ""), text).otherwise(F.concat(lead, body, tail))


def cell_run(rendered: Column, math: Column, mono: Column, raw: Column) -> Column:
    """A bar would end a table's cell: in formulas, code and raw text, which are not escaped, it gets a backslash."""
    return F.when(math | mono | raw, F.replace(rendered, F.lit("|"), F.lit("\\|"))).otherwise(rendered)


#: Function names with a macro of their own in LaTeX.
OPERATORS = ("max", "min", "sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp", "lim", "det", "gcd", "tanh", "sinh", "cosh")


def operator_macro(name: Column) -> Column:
    return F.when(name.isin(*OPERATORS), F.concat(F.lit("\\"), name)).otherwise(name)


def is_continuation_marker(c: Column) -> Column:
    """Nothing but blanks and the triangles that say that a table goes on."""
    return c.rlike("^[ ▽△]*[▽△][ ▽△]*$")


def joins_tight(left: Column, right: Column) -> Column:
    """Two cells of a label join without a blank where a connector ends one or begins the other."""
    return left.rlike("[_./-]$") | right.rlike("^[_./-]")


def keeps_hyphen(token: Column) -> Column:
    """A wrapped token that keeps its last hyphen: it holds another hyphen, or a brace."""
    return F.regexp_replace(token, "[-‐­]+$", "").rlike("[-‐{}]")


def same_columns(a: Column, b: Column, size: Column) -> Column:
    """Column edges of equal number, each within max(3, 0.4 size) of the other's."""
    far = F.greatest(F.lit(3.0), 0.4 * F.greatest(size, F.lit(1.0)))
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= far), lambda x: x)


# Letters whose capital is one character though the full mapping gives several, with that; and letters whose capitals are
# newer than Unicode 15, which keep themselves.
CAPITALS = {"\u00df": "\u1e9e", "\u1fb3": "\u1fbc", "\u1fc3": "\u1fcc", "\u1ff3": "\u1ffc"} | {chr(n): chr(n + 8) for a in (0x1F80, 0x1F90, 0x1FA0) for n in range(a, a + 8)}
NEW_CAPITALS = "[\u019b\u0264\u1c8a\ua7cd\ua7db\U00010d70-\U00010d85]"


def capital(ch: Column) -> Column:
    """One character as its capital, which is one character too: where it has none, itself."""
    several = (F.length(F.upper(ch)) > 1) | ch.rlike(NEW_CAPITALS)
    return F.when(several, F.translate(ch, "".join(CAPITALS), "".join(CAPITALS.values()))).otherwise(F.upper(ch))


def math_extension(ch: Column, font: Column) -> Column:
    """Large operators of TeX's extension font, which come as the letters of their slots."""
    return F.when(font.rlike("(?i)cmex"), F.translate(ch, "PXQY", "\u2211\u2211\u220f\u220f")).otherwise(ch)


def font_flags(flags: Column, name: Column, weight: Column, cjk: Column) -> dict[str, Column]:
    """Styles from a font descriptor's flags, name and weight; a fixed pitch says nothing of CJK glyphs."""
    style = font_style(name, weight)
    bit = lambda n: flags.bitwiseAND(1 << n) != 0
    return {"bold": style["bold"] | bit(18), "italic": style["italic"] | bit(6), "mono": (style["mono"] | bit(0)) & ~cjk}


def affine(x: Column, y: Column, m: tuple[Column, ...]) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def is_greek(ch: Column) -> Column:
    return ch.rlike(f"^[{GREEK}]$")


# Signs that make a line mathematics.
MATH = "\u2212\u221e\u00d7\u00f7\u00b1\u2208\u2209\u2264\u2265\u2260\u2248\u2261\u221a\u2211\u220f\u222b\u2202\u2207\u2192\u2190\u21d2\u21d0\u2286\u2287\u2295\u2297\u2299\u2218"

# Macros of Greek letters and signs in LaTeX; those of a word end in a blank.
LATEX = {
    "\u03b1": "alpha", "\u03b2": "beta", "\u03b3": "gamma", "\u03b4": "delta", "\u03b5": "epsilon", "\u03f5": "epsilon", "\u03b6": "zeta", "\u03b7": "eta", "\u03b8": "theta", "\u03ba": "kappa", "\u03bb": "lambda",
    "\u03bc": "mu", "\u03bd": "nu", "\u03be": "xi", "\u03c0": "pi", "\u03c1": "rho", "\u03c3": "sigma", "\u03c4": "tau", "\u03c7": "chi", "\u03c8": "psi", "\u03c9": "omega", "\u03c6": "phi", "\u03d5": "phi",
    "\u0393": "Gamma", "\u0394": "Delta", "\u0398": "Theta", "\u039b": "Lambda", "\u03a0": "Pi", "\u03a3": "Sigma", "\u03a6": "Phi", "\u03a8": "Psi", "\u03a9": "Omega",
    "\u221a": "surd", "\u221e": "infty", "\u2211": "sum", "\u220f": "prod", "\u222b": "int", "\u2202": "partial", "\u2207": "nabla", "\u2208": "in", "\u00d7": "times", "\u00b7": "cdot", "\u22c5": "cdot",
    "\u2264": "leq", "\u2265": "geq", "\u2260": "neq", "\u2248": "approx", "\u2261": "equiv", "\u00b1": "pm", "\u2192": "rightarrow", "\u2190": "leftarrow", "\u21d2": "Rightarrow", "\u21d0": "Leftarrow",
    "\u00f7": "div", "\u2209": "notin", "\u2286": "subseteq", "\u2287": "supseteq", "\u2295": "oplus", "\u2297": "otimes", "\u2299": "odot", "\u2218": "circ", "\u2026": "ldots",
}


def latex_symbol(ch: Column) -> Column:
    """A character as LaTeX shows it: a macro with a blank after it, a plain sign, or with a backslash if active."""
    macro = F.create_map(*[F.lit(x) for k, v in LATEX.items() for x in (k, v)])[ch]
    return F.when(macro.isNotNull(), F.concat(F.lit("\\"), macro, F.lit(" "))).when(ch == "\u2212", "-").when(ch == "\u2032", "'").when(ch.isin(*"%#&$_{}"), F.concat(F.lit("\\"), ch)).otherwise(ch)


def script_role(size: Column, y: Column, baseline: Column, largest: Column) -> Column:
    """0, 1 (raised) or 2 (lowered): glyphs under 0.82 of the line's size, off its baseline."""
    off = y - baseline
    return F.when(size >= 0.82 * largest, 0).when(off > 0.10 * largest, 1).when(off < -0.06 * largest, 2).otherwise(0)


def footnote_ref(latex: Column) -> tuple[Column, Column]:
    """Word and number of a formula that is but a word with a raised number; empty where it is none."""
    form = r"^\\text\{([A-Za-z]{2,})\}\^(?:([0-9]+)|\{([0-9]+)\})$"
    return F.regexp_extract(latex, form, 1), F.concat(F.regexp_extract(latex, form, 2), F.regexp_extract(latex, form, 3))


def literal_hyphen(head: Column, tail: Column) -> tuple[Column, Column]:
    """Whether the last word of `head`, which ends in a wrap hyphen, shows that the hyphen is its own, and the word that
    would gainsay it if it were attested (else empty): an open brace does; so does a hyphen inside it with nothing but
    letters and digits behind."""
    word = F.regexp_extract(F.regexp_replace(head, "[-\u2010\u00ad]+$", ""), "([^ ]+)$", 1)
    depth = F.length(F.regexp_replace(word, "[^{]", "")) - F.length(F.regexp_replace(word, "[^}]", ""))
    piece = F.regexp_extract(word, "[-\u2010]([^-\u2010]*)$", 1)
    chain = word.rlike("[-\u2010][A-Za-z0-9]*$")
    right = F.regexp_extract(tail, "^([A-Za-z]+)", 1)
    joined = F.when(chain & (depth <= 0) & (piece != "") & (right != ""), ascii_lower(F.concat(piece, right))).otherwise("")
    return (word != "") & ((depth > 0) | chain), joined


def heading_text(c: Column) -> Column:
    """A run of # at the end would close the heading: its first is escaped."""
    return F.regexp_replace(c, "(#+)$", r"\\$1")
