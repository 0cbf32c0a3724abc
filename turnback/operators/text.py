"""Reversible string operators. Each keeps an edit script from its result back to its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnback.functions import tokens as T
from turnback.functions.diff import patch_col, script_col

from .base import Op


class _Edit(Op):
    """A string to string map with a script from the result back."""

    ins = ("strings",)
    outs = ("target", "diff")

    def change(self, c):
        raise NotImplementedError

    def forward(self, cols):
        c = self.args(cols)["strings"]
        t = self.change(c)
        return {"target": t, "diff": script_col(t, c)}

    def inverse(self, cols):
        return {"strings": patch_col(cols["target"], cols["diff"])}


class LowerCase(_Edit):
    name = "lower_case"

    def change(self, c):
        return F.lower(c)


class HalfWidth(_Edit):
    """Unicode NFKC. ASCII strings, which it never changes, stay out of Python."""

    name = "half_width"

    def change(self, c):
        wide = F.octet_length(c) != F.length(c)
        return F.when(wide, T.mapped(F.when(wide, c), "nfkc")).otherwise(c)


class ReplaceSubstring(_Edit):
    """All occurrences of ``old`` replaced by ``new``, literally."""

    name = "replace_substring"

    def change(self, c):
        return F.replace(c, F.lit(self.params["old"]), F.lit(self.params["new"]))


class Lemmatize(_Edit):
    """The registered callable ``lemmatizer`` on each string."""

    name = "lemmatize"

    def change(self, c):
        return T.mapped(c, self.params["lemmatizer"])


class Tokenize(Op):
    """``max_len`` tokens (padded with '' or cut) and the script from their detokenised text to the input."""

    name = "tokenize"
    ins = ("strings",)
    outs = ("target", "diff")

    def forward(self, cols):
        c = self.args(cols)["strings"]
        toks = T.fixed(T.tokens(c, self.params["tokenizer"]), self.params["max_len"])
        return {"target": toks, "diff": script_col(T.text(toks, self.params["detokenizer"]), c)}

    def inverse(self, cols):
        return {"strings": patch_col(T.text(cols["target"], self.params["detokenizer"]), cols["diff"])}


class MultiTokenize(Op):
    """Tokenizer and detokenizer by ``selector``, from dicts; an unlisted selector raises."""

    name = "multi_tokenize"
    ins = ("strings", "selector")
    outs = ("target", "diff", "selector")

    def _by(self, sel, c, named, make):
        """``make`` of each function's name, on the rows of the selectors that have it: a function in Python sees no others."""
        out = F.raise_error(F.concat(F.lit("no tokenizer for "), F.coalesce(sel, F.lit("null"))))
        for name in dict.fromkeys(named[k] for k in self.params["tokenizers"]):
            mine = sel.isin([k for k in self.params["tokenizers"] if named[k] == name])
            out = F.when(mine, make(F.when(mine, c), name)).otherwise(out)
        return out

    def forward(self, cols):
        x = self.args(cols)
        c, sel = x["strings"], x["selector"]
        toks = self._by(sel, c, self.params["tokenizers"], lambda s, k: T.fixed(T.tokens(s, k), self.params["max_len"]))
        return {"target": toks, "diff": script_col(self._by(sel, toks, self.params["detokenizers"], T.text), c), "selector": sel}

    def inverse(self, cols):
        sel = cols["selector"]
        back = self._by(sel, cols["target"], self.params["detokenizers"], T.text)
        return {"strings": patch_col(back, cols["diff"]), "selector": sel}


def flat_tokenize(df: DataFrame, text: str, ids: list[str], tokenizer: str = "whitespace", detokenizer: str = "join") -> DataFrame:
    """A row for each token: ids, pos, token, diff (the script from the detokenised text, on the first token alone)."""
    x = df.select(*ids, F.col(text).alias("__text")).withColumn("__toks", T.tokens(F.col("__text"), tokenizer))
    x = x.withColumn("__diff", script_col(F.coalesce(T.text(F.col("__toks"), detokenizer), F.lit("")), F.col("__text")))
    x = x.select(*ids, "__diff", F.posexplode_outer("__toks").alias("pos", "token"))
    return x.select(*ids, F.coalesce("pos", F.lit(0)).alias("pos"), "token", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("__diff")).alias("diff"))


def flat_detokenize(flat: DataFrame, ids: list[str], text: str = "text", detokenizer: str = "join") -> DataFrame:
    """The texts of :func:`flat_tokenize`. One shuffle by id; a text's tokens meet in one row, as the text itself does."""
    g = flat.groupBy(*ids).agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token")))).alias("__t"), F.max("diff").alias("__d"))
    toks = F.transform("__t", lambda s: s["token"])
    return g.select(*ids, F.when(F.col("__d").isNotNull(), patch_col(F.coalesce(T.text(toks, detokenizer), F.lit("")), F.col("__d"))).alias(text))
