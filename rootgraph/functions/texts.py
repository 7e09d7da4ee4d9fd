"""Texts as chains: a root, then a node for each word, each pointing to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootgraph.functions.bits import fold
from rootgraph.operators.graph import GraphError, pin

#: a longest run of ASCII digits, ASCII letters and characters beyond ASCII
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words in order, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _longer(edges: int) -> Callable[[Column, Column], Column]:
    """The digest of a path that ends at word j, lengthened to ``edges`` edges at its upstream end; null where the chain begins."""
    return lambda h, j: F.when(j >= edges, F.sha2(F.concat_ws("|", h, F.lit("1"), F.get(F.col("_seed"), j - edges)), 256))


def with_chain_bits(df: DataFrame, text: str, n_bits: int = 1024, max_edges: int = 3) -> DataFrame:
    """Adds ``n_words`` and ``on_bits``: the directed-path descriptor of the chain of a text's words, all bonds single.

    The same bits as those of ``graph.path_fingerprint`` over the chain as a graph row, in work that follows the words:
    each round lengthens the path that ends at each word by one edge, so a text costs ``max_edges`` + 1 digests a word.
    Works on streams. Null, empty and wordless texts have no bits.
    """
    if max_edges < 1:
        raise GraphError(f"a path has at least one edge, not {max_edges}")
    root = F.sha2(F.lit("'ROOT'"), 256)
    out = pin(df, "_seed", F.concat(F.array(root), F.transform(words(F.col(text)), lambda w: F.sha2(w, 256))))
    last = "_seed"
    for e in range(1, max_edges + 1):
        out = pin(out, f"_h{e}", F.transform(last, _longer(e)))
        last = f"_h{e}"
    made = [f"_h{e}" for e in range(1, max_edges + 1)]
    bit = F.transform(F.filter(F.concat(*made), lambda h: h.isNotNull()), lambda h: fold(h, n_bits))
    out = out.withColumns({"n_words": F.size("_seed") - 1, "on_bits": F.sort_array(F.array_distinct(bit))})
    return out.drop("_seed", *made)
