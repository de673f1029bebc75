"""Taxon sets as bit masks: one BIGINT up to 62 taxa, an array of them beyond.

The top two bits of a word stay free, so that no mask is negative and sums of words cannot overflow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 62


@dataclass(frozen=True)
class Masks:
    """The set algebra for n taxa; every method takes and gives columns."""

    n: int

    @property
    def words(self) -> int:
        return max(1, -(-self.n // WORD))

    @property
    def wide(self) -> bool:
        return self.words > 1

    @property
    def type(self) -> str:
        return "array<bigint>" if self.wide else "bigint"

    def _literal(self, values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values]) if self.wide else F.lit(values[0]).cast("long")

    def pack(self, mask: int):
        """A Python integer over all taxa as the value a column holds."""
        words = [mask >> (WORD * w) & ((1 << WORD) - 1) for w in range(self.words)]
        return words if self.wide else words[0]

    def unpack(self, value) -> int:
        return sum(int(v) << (WORD * w) for w, v in enumerate(value)) if self.wide else int(value)

    def lit(self, mask: int) -> Column:
        packed = self.pack(mask)
        return self._literal(packed if self.wide else [packed])

    @property
    def full(self) -> Column:
        return self.lit((1 << self.n) - 1)

    @property
    def empty(self) -> Column:
        return self.lit(0)

    def union_of(self, taxon: Column | str) -> Column:
        """Aggregate: the set of all taxa in the group."""
        t = F.col(taxon) if isinstance(taxon, str) else taxon
        one = lambda w: F.coalesce(F.bit_or(F.when(F.floor(t / WORD) == w, F.expr("1L").cast("long") * F.pow(F.lit(2.0), t % WORD).cast("long"))), F.lit(0).cast("long"))
        return F.array(*[one(w) for w in range(self.words)]) if self.wide else one(0)

    def merged(self, mask: Column | str) -> Column:
        """Aggregate: the union of masks."""
        m = F.col(mask) if isinstance(mask, str) else mask
        return F.array(*[F.bit_or(F.element_at(m, w + 1)) for w in range(self.words)]) if self.wide else F.bit_or(m)

    def _zip(self, a: Column, b: Column, f) -> Column:
        return F.zip_with(a, b, f) if self.wide else f(a, b)

    def both(self, a: Column, b: Column) -> Column:
        return self._zip(a, b, lambda x, y: x.bitwiseAND(y))

    def either(self, a: Column, b: Column) -> Column:
        return self._zip(a, b, lambda x, y: x.bitwiseOR(y))

    def less(self, a: Column, b: Column) -> Column:
        """a without b."""
        return self._zip(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))

    def rest(self, a: Column) -> Column:
        return self.less(self.full, a)

    def count(self, a: Column) -> Column:
        """Taxa in the set, as BIGINT so that products don't overflow."""
        if self.wide:
            return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x).cast("long"))
        return F.bit_count(a).cast("long")

    def shared(self, a: Column, b: Column) -> Column:
        return self.count(self.both(a, b))

    def subset(self, a: Column, b: Column) -> Column:
        return self.both(a, b) == a

    def has(self, a: Column, taxon: int) -> Column:
        return self.both(a, self.lit(1 << taxon)) != self.empty

    def members(self, a: Column) -> Column:
        """The taxa of a set, as an array."""
        word = (lambda t: F.element_at(a, (t / WORD).cast("int") + 1)) if self.wide else (lambda t: a)
        return F.filter(F.sequence(F.lit(0), F.lit(self.n - 1)), lambda t: F.getbit(word(t), t % WORD) == 1)

    def least(self, a: Column) -> Column:
        """The lowest taxon of a set that isn't empty."""
        low = lambda x: F.bit_count(x.bitwiseXOR(x - F.lit(1).cast("long"))) - 1
        if not self.wide:
            return low(a)
        first = F.array_position(F.transform(a, lambda x: x != 0), F.lit(True)).cast("int")
        return (first - 1) * WORD + low(F.element_at(a, first))
