"""Feature grammar and token helpers as column expressions.

A document feature is a string of ``_``-joined tokens.  In PoS mode a token is
``text/TAG``; the feature type follows from the tag sequence:

    1 token          -> 1-GRAM
    (J, N)           -> AN        (N, N) -> NN        (V, N) -> VO
    other pairs      -> 2-GRAM
    (N, V, N)        -> SVO
    other triples    -> 3-GRAM
    malformed / >3   -> EMPTY

In no-PoS mode a token is any non-empty run without ``/`` or ``_`` and the type
depends on the token count only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feature grammar.
NGRAM_SEPARATOR = "_"
POS_SEPARATOR = "/"
TOKEN_PATTERN = r"^([^/_]+)/([A-Z]+)$"
NOPOS_TOKEN_PATTERN = r"^[^/_]+$"
FEATURE_TYPES = ("1-GRAM", "2-GRAM", "3-GRAM", "AN", "NN", "VO", "SVO", "EMPTY")
NP_TYPES = ("AN", "NN")
COMPOSABLE_TYPES = ("2-GRAM", "3-GRAM", "AN", "NN", "VO", "SVO")
SPARSE_OUTPUT_TYPES = ("AN", "NN", "VO", "SVO", "1-GRAM")
UNIGRAM_POS = ("N", "J", "V")

# Coarse tags for Penn Treebank tags (EXT-4), matched by prefix in this order.
PENN_PREFIX_TO_COARSE = (
    ("NN", "N"), ("VB", "V"), ("MD", "V"), ("JJ", "J"), ("RB", "RB"),
    ("DT", "DET"), ("PRP", "PRON"), ("WP", "PRON"), ("IN", "CONJ"), ("CC", "CONJ"),
)
PUNCT_TAGS = (".", ",", ":", "``", "''", "-LRB-", "-RRB-", "#", "$", "(", ")")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_tokens(feature) -> Column:
    """B1 helper: the raw token strings of a feature."""
    return F.split(_c(feature), NGRAM_SEPARATOR)


#: A tagged token within a feature, as ``TOKEN_PATTERN`` takes it: ``$`` allows a last line end.
_TAGGED = r"[^/_]+/%s(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?"


def _tagged(*tags: str) -> str:
    return "^" + "_".join(_TAGGED % t for t in tags) + r"\z"


def feature_type(feature, pos_mode: bool = True) -> Column:
    """B1: the feature type, computed from the tag sequence."""
    if not pos_mode:
        toks = split_tokens(feature)
        n = F.size(toks)
        ok = F.forall(toks, lambda t: t.rlike(NOPOS_TOKEN_PATTERN))
        return (F.when(~ok, "EMPTY").when(n == 1, "1-GRAM").when(n == 2, "2-GRAM")
                .when(n == 3, "3-GRAM").otherwise("EMPTY"))
    any_tag = "[A-Z]+"

    # matched as a whole, by number of tokens: taking it apart costs many times as much
    def kind(f: Column) -> Column:
        return (F.when(f.rlike("_[^_]*_[^_]*_"), "EMPTY")
                .when(f.rlike("_[^_]*_"), F.when(f.rlike(_tagged("N", "V", "N")), "SVO").when(f.rlike(_tagged(any_tag, any_tag, any_tag)), "3-GRAM").otherwise("EMPTY"))
                .when(f.contains(NGRAM_SEPARATOR), F.when(f.rlike(_tagged("J", "N")), "AN").when(f.rlike(_tagged("N", "N")), "NN")
                      .when(f.rlike(_tagged("V", "N")), "VO").when(f.rlike(_tagged(any_tag, any_tag)), "2-GRAM").otherwise("EMPTY"))
                .when(f.rlike(_tagged(any_tag)), "1-GRAM")
                .when(f.isNotNull(), "EMPTY").otherwise("3-GRAM"))

    # bound by a lambda: where the feature is an expression, it is computed once, not for each test
    return F.get(F.transform(F.array(_c(feature)), kind), 0)


def parse_feature(feature, pos_mode: bool = True) -> Column:
    """B1: ``STRUCT<type, tokens ARRAY<STRUCT<text, pos>>>``; pos is NULL without tags."""
    toks = split_tokens(feature)
    if pos_mode:
        parsed = F.transform(toks, lambda t: F.struct(
            F.regexp_extract(t, TOKEN_PATTERN, 1).alias("text"),
            F.regexp_extract(t, TOKEN_PATTERN, 2).alias("pos")))
    else:
        parsed = F.transform(toks, lambda t: F.struct(
            t.alias("text"), F.lit(None).cast("string").alias("pos")))
    return F.struct(feature_type(feature, pos_mode).alias("type"), parsed.alias("tokens"))


def render_tokens(tokens) -> Column:
    """B2: join ``STRUCT<text,pos>`` tokens back into a feature string."""
    return F.array_join(F.transform(_c(tokens), lambda t: F.when(
        t["pos"].isNull(), t["text"]).otherwise(F.concat(t["text"], F.lit(POS_SEPARATOR), t["pos"]))),
        NGRAM_SEPARATOR)


def token_at(feature, index: int) -> Column:
    """Token string at ``index`` (negative counts from the end); NULL when out of range."""
    if index in (0, -1):  # the first and the last are there without cutting the rest
        return F.substring_index(_c(feature), NGRAM_SEPARATOR, -1 if index else 1)
    toks = split_tokens(feature)
    if index >= 0:
        return F.get(toks, F.lit(index))
    return F.try_element_at(toks, F.lit(index))


def tail(feature, start: int = 1) -> Column:
    """``feature[start:]`` rendered as a feature string."""
    toks = split_tokens(feature)
    return F.array_join(F.slice(toks, start + 1, F.greatest(F.size(toks) - start, F.lit(0))),
                        NGRAM_SEPARATOR)


def smart_lower(token) -> Column:
    """Lowercase the word, keep the tag."""
    t = _c(token)
    return F.when(t.contains(POS_SEPARATOR),
                  F.concat(F.lower(F.substring_index(t, POS_SEPARATOR, 1)), F.lit(POS_SEPARATOR),
                           F.substring_index(t, POS_SEPARATOR, -1))).otherwise(F.lower(t))


def strip_pos(token) -> Column:
    """Text before the first ``/``."""
    return F.substring_index(_c(token), POS_SEPARATOR, 1)


def pos_of(token) -> Column:
    return F.regexp_extract(_c(token), TOKEN_PATTERN, 2)


def coarse_pos(fine_tag) -> Column:
    """Penn tag -> coarse tag (EXT-4 ruling)."""
    t = _c(fine_tag)
    expr = F.when(t.isin(*PUNCT_TAGS), "PUNCT")
    for prefix, coarse in PENN_PREFIX_TO_COARSE:
        expr = expr.when(t.startswith(prefix), coarse)
    return expr.otherwise("UNK")


def row_rename(entry) -> Column:
    """Spaces become the n-gram separator."""
    return F.replace(_c(entry), F.lit(" "), F.lit(NGRAM_SEPARATOR))


def dimension_names(d: int, pattern: str = "f%02d") -> Column:
    """``format_string`` over ``sequence`` gives the names of dense columns."""
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.format_string(pattern, i))


# ---- C1-C10 predicates -------------------------------------------------------

def default_row_filter(feature, kind=None) -> Column:
    """Single tagged word with tag N, J or V.  ``kind``: the feature's type, where it is
    a column already."""
    return ((feature_type(feature) if kind is None else _c(kind)) == "1-GRAM") & pos_of(feature).isin(*UNIGRAM_POS)


def default_row_filter_nopos(feature) -> Column:
    """No n-gram separator and no tag separator."""
    f = _c(feature)
    return ~f.contains(NGRAM_SEPARATOR) & ~f.contains(POS_SEPARATOR)


def nouns_only(feature) -> Column:
    """C3."""
    return (feature_type(feature) == "1-GRAM") & (pos_of(feature) == "N")


def type_in(feature, types, kind=None) -> Column:
    """C4 / C10; ``kind`` as in C1."""
    return (feature_type(feature) if kind is None else _c(kind)).isin(*types)


def embedding_junk_filter(entry) -> Column:
    """Well-formed and 3 < len(entry) < 20, tag included."""
    return (feature_type(entry) != "EMPTY") & (F.length(_c(entry)) > 3) & (F.length(_c(entry)) < 20)


def has_punct_or_digit(word) -> Column:
    """ASCII punctuation or a digit anywhere in the word."""
    return _c(word).rlike(r"[!-/:-@\[-`{-~0-9]")


def without_unknown(text) -> Column:
    """Literal ``*UNKNOWN*`` test (no regex)."""
    return ~_c(text).contains("*UNKNOWN*")
