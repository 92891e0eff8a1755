"""Sequence tokens, padding and masks as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The vocabulary in the order of its ids.
VOCABULARY = (
    "[pad] A T C G a t c g B D E F H I J K L M N O P Q R S U V W X Y Z b d e f h i j k l m n o p q r s u v w x y z - @ # | _ <space> ; [MASK] <bos> <eos>"
).split()
VOCABULARY[VOCABULARY.index("<space>")] = " "
IDS = {token: i for i, token in enumerate(VOCABULARY)}
PAD, UNKNOWN, GAP, MASK, BOS, EOS = IDS["[pad]"], IDS["N"], IDS["-"], IDS["[MASK]"], IDS["<bos>"], IDS["<eos>"]
MULTIPLE, LEAST, LIMIT, PADDING_MULTIPLE, PADDING_LIMIT = 128, 256, 128_000, 256, 524_288


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, wherever lambdas look at it again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _lookup(token: Column, unknown: int) -> Column:
    ids = F.create_map(*[F.lit(x) for kv in IDS.items() for x in kv])
    return F.coalesce(F.try_element_at(ids, token), F.lit(unknown))


def token_ids(text: Column, pad_to: int | None = None, max_length: int | None = None, ends: bool = False) -> Column:
    """Ids of the characters; unknown ones count as N. Optional begin and end, then padding or a cut."""
    ids = F.filter(F.transform(F.split(text, ""), lambda x: F.when(x != "", _lookup(x, UNKNOWN))), lambda x: x.isNotNull())
    if ends:
        ids = F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))
    if max_length is not None:
        cut = F.concat(F.slice(ids, 1, max_length - 1), F.array(F.lit(EOS))) if ends else F.slice(ids, 1, max_length)
        ids = F.when(F.size(ids) > max_length, cut).otherwise(ids)
    if pad_to is not None:
        ids = _once(ids, lambda ids: F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), F.lit(pad_to) - F.size(ids)))))
    return ids


def token_id(token: Column) -> Column:
    """Id of a single token; unknown ones count as a gap."""
    return _lookup(token, GAP)


def upper_ids(ids: Column) -> Column:
    """a t c g n as A T C G N."""
    fold = F.create_map(*[F.lit(x) for a in "atcgn" for x in (IDS[a], IDS[a.upper()])])
    return F.transform(ids, lambda x: F.coalesce(F.try_element_at(fold, x), x))


def split_tokens(text: Column) -> Column:
    """White space separates tokens; | is one of its own, written [SEP]."""
    return F.filter(F.split(F.replace(text, F.lit("|"), F.lit(" [SEP] ")), r"\s+"), lambda x: x != "")


def with_separator(ids: Column, separator: int, second: Column | None = None) -> Column:
    """A sequence, or two, each followed by a separator."""
    one = F.concat(ids, F.array(F.lit(separator)))
    return one if second is None else F.concat(one, second, F.array(F.lit(separator)))


def separator_mask(ids: Column, separator: int) -> Column:
    return F.transform(ids, lambda x: (x == separator).cast("int"))


def padding_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x == PAD).cast("int"))


def special_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: x.isin(BOS, EOS).cast("int"))


def valid_mask(ids: Column) -> Column:
    """Neither padding nor begin or end."""
    return F.transform(ids, lambda x: (~x.isin(PAD, BOS, EOS)).cast("int"))


def masked_ids(ids: Column, rate: float, seed: str = "0") -> Column:
    """Of the positions that aren't padding the share ``rate``, chosen by a hash of the place, is
    looked at; bases among them become [MASK]."""
    place = lambda i: F.xxhash64(F.lit(seed), i)  # noqa: E731  of an int: no two places share a hash, so the last chosen one tells all
    bases = [IDS[x] for x in "ATCGatcg"]

    def masked(ids):
        places = F.filter(F.transform(ids, lambda x, i: F.when(x != PAD, place(i))), lambda h: h.isNotNull())
        last = _once(F.sort_array(places), lambda h: F.get(h, F.least(F.size(h), F.floor(F.size(h) * rate).cast("int")) - 1))
        return _once(last, lambda last: F.transform(ids, lambda x, i: F.when((place(i) <= last) & x.isin(*bases), F.lit(MASK)).otherwise(x)))

    return _once(ids, masked)


def model_length(length: Column) -> Column:
    """Length after padding for the model: at least LEAST, a multiple of MULTIPLE; null beyond LIMIT."""
    padded = (F.ceil(F.greatest(length, F.lit(LEAST)) / MULTIPLE) * MULTIPLE).cast("long")
    return F.when(padded <= LIMIT, padded)


def padding_length(longest: Column) -> Column:
    """Common length of a group's sequences: a multiple of 256 up to the limit."""
    return F.least((F.ceil(longest / PADDING_MULTIPLE) * PADDING_MULTIPLE).cast("long"), F.lit(PADDING_LIMIT).cast("long"))


def batch_size(length: Column, large: bool = True) -> Column:
    """Sequences of a batch by length; a large device takes twice as many up to the last step."""
    steps = ((8192, 16), (25344, 8), (51712, 4), (124672, 2), (197888, 1))
    out = F.when(length >= 300_000, 1).otherwise(2)
    for most, n in reversed(steps):
        out = F.when(length <= most, n * (2 if large else 1)).otherwise(out)
    return out.cast("int")
