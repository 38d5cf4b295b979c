"""Keyword scoring as bit masks.

Each keyword of a dictionary owns one bit. A text becomes one bigint per 62 keywords, with
the bit set when the keyword occurs. Masks of the lines of one call combine with
``bit_or``, so a call is scored from its turns with a map-side combine and no transcript
ever has to be assembled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .base import blank_to_null, constant, let

_BITS = 62


class KeywordIndex:
    """Bit layout of one dictionary ``{category: (keyword, ...)}``."""

    def __init__(self, dictionary: Mapping[str, Sequence[str]]):
        self.categories = list(dictionary)
        placed = [
            (category, keyword)
            for category, keywords in dictionary.items()
            for keyword in dict.fromkeys(keywords)
        ]
        self.words = max(1, -(-len(placed) // _BITS))
        self._keywords: list[list[tuple[str, int]]] = [[] for _ in range(self.words)]
        self._masks = {category: [0] * self.words for category in self.categories}
        for n, (category, keyword) in enumerate(placed):
            word, bit = divmod(n, _BITS)
            self._keywords[word].append((keyword, 1 << bit))
            self._masks[category][word] |= 1 << bit

    def masks(self, text: Column) -> list[Column]:
        """One bigint column per mask word. The keywords travel as one literal array, which
        keeps the generated code small enough to be compiled whatever the pack's size."""

        def word(entries: list[tuple[str, int]]) -> Column:
            table = constant([{"k": k, "b": b} for k, b in entries], "array<struct<k:string,b:bigint>>")
            return let(
                text,
                lambda t: F.aggregate(
                    F.filter(table, lambda e: t.contains(e["k"])),
                    F.lit(0).cast("bigint"),
                    lambda acc, e: acc.bitwiseOR(e["b"]),
                ),
            )

        return [word(entries) if entries else F.lit(0).cast("bigint") for entries in self._keywords]

    def count(self, masks: Sequence[Column], category: str) -> Column:
        """Number of distinct keywords of one category that were seen."""
        parts = [
            F.bit_count(mask.bitwiseAND(F.lit(bits).cast("bigint")))
            for mask, bits in zip(masks, self._masks[category])
            if bits
        ]
        return sum(parts[1:], parts[0]) if parts else F.lit(0)

    def ranked(self, masks: Sequence[Column]) -> Column:
        """``array<struct<category, score>>`` without zeros, best first, ties in dictionary order."""
        fields = "".join(f",m{n}:bigint" for n in range(self.words))
        table = constant(
            [
                {"p": position, "c": category, **{f"m{n}": bits for n, bits in enumerate(self._masks[category])}}
                for position, category in enumerate(self.categories)
            ],
            f"array<struct<p:int,c:string{fields}>>",
        )

        def entry(e: Column) -> Column:
            score = F.bit_count(masks[0].bitwiseAND(e["m0"]))
            for n in range(1, self.words):
                score = score + F.bit_count(masks[n].bitwiseAND(e[f"m{n}"]))
            return F.struct((-score).alias("rank"), e["p"].alias("position"), e["c"].alias("category"))

        scored = F.filter(F.transform(table, entry), lambda e: e["rank"] < 0)
        return F.transform(
            F.sort_array(scored),
            lambda e: F.struct(e["category"].alias("category"), (-e["rank"]).alias("score")),
        )


def keyword_scores(text: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """Category scores of a lower-cased text: distinct keywords present, best first."""
    index = KeywordIndex(dictionary)
    return let(F.array(*index.masks(F.lower(text))), lambda m: index.ranked(unpack(m, index.words)))


def unpack(masks: Column, words: int) -> list[Column]:
    return [masks[n] for n in range(words)]


def top_category(ranked: Column, default: str) -> Column:
    return F.coalesce(F.get(ranked, F.lit(0))["category"], F.lit(default))


def joined_categories(ranked: Column, n: int, separator: str, default: str) -> Column:
    names = F.transform(F.slice(ranked, 1, n), lambda e: e["category"])
    return F.coalesce(blank_to_null(F.array_join(names, separator)), F.lit(default))
