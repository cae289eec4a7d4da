"""Frames cut from bit streams, and the frames of many channels as one stream: folds for batches and streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from spectraloom.operators.carried import carried


@dataclass(frozen=True)
class LengthRules:
    """When a frame ends: at the first of its field's length, its terminator with what trails it, and ``most`` bits.

    The field's value is looked up in ``cases`` (least, most, bits), else it counts ``scale`` bits each on top of ``add`` where
    there is a scale, else ``default`` holds. A frame is never shorter than what its field takes to read. Terminators are looked
    for at every ``step`` bits from the frame's start.
    """

    most: int
    offset: int = 0  # bits passed over after a break
    field: tuple[int, int] | None = None  # first bit and number of bits
    cases: tuple[tuple[int, int, int], ...] = ()
    scale: int = 0
    add: int = 0
    default: int | None = None
    words: tuple[str, ...] = ()
    step: int = 1
    trailer: int = 0

    def __post_init__(self) -> None:
        if self.most < 1 or self.step < 1:
            raise ValueError("frames have at least one bit, terminators a step")
        if self.field and sum(self.field) > self.most:
            raise ValueError("the length field ends beyond the longest frame")

    def told(self, bits: str) -> int | None:
        """The length that a frame's field tells, once its bits are there."""
        if not self.field or len(bits) < sum(self.field):
            return None
        first, n = self.field
        value = int(bits[first : first + n], 2)
        length = next((b for low, high, b in self.cases if low <= value <= high), None)
        if length is None:
            length = value * self.scale + self.add if self.scale else self.default
        return None if length is None else max(first + n, length)

    def closed(self, bits: str) -> int | None:
        """Where the first terminator and its trailer end."""
        best = None
        for word in self.words:
            at = bits.find(word, 0, self.most)
            while at >= 0 and (at + len(word)) % self.step:
                at = bits.find(word, at + 1, self.most)
            if at >= 0 and (best is None or at + len(word) < best):
                best = at + len(word)
        return None if best is None else best + self.trailer

    def end(self, bits: str) -> tuple[int, str] | None:
        """Length of the frame that ``bits`` begin with and what ended it, or null if it isn't all there."""
        ends = [(n, how) for n, how in ((self.told(bits), "length"), (self.closed(bits), "terminator"), (self.most, "most")) if n is not None]
        n, how = min(ends, key=lambda e: e[0])
        return (n, how) if n <= len(bits) else None


#: What ``Deframe`` gives: the frame's number, its first bit's place in the key's stream, its length, what ended it, its bits.
FRAMES = "frame long, first_bit long, n_bits int, ended string, bits string"


class Deframe:
    """Consecutive frames of a key's bits; a block (…, bits, reset) that says ``reset``, or is null, breaks the stream.

    What a break leaves unfinished is dropped. The state is less than one frame's bits.
    """

    def __init__(self, rules: LengthRules):
        self.rules = rules

    def start(self) -> dict:
        return {"rest": "", "skip": self.rules.offset, "bit": 0, "frames": 0}

    def step(self, state: dict, row: tuple) -> Iterator[tuple]:
        bits, reset = row[-2:]
        if reset or bits is None:
            state["bit"] += len(state["rest"])
            state["rest"], state["skip"] = "", self.rules.offset
        text = state["rest"] + (bits or "")
        over = min(state["skip"], len(text))
        state["skip"] -= over
        at = over
        while found := self.rules.end(text[at : at + self.rules.most]):
            n, how = found
            yield state["frames"], state["bit"] + at, n, how, text[at : at + n]
            state["frames"] += 1
            at += n
        state["rest"] = text[at:]
        state["bit"] += at

    def end(self, state: dict) -> tuple:
        return ()


def deframed(blocks: DataFrame, keys: list[str], order: list[str], bits: str, reset: str, rules: LengthRules) -> DataFrame:
    """keys and ``FRAMES`` of the blocks of bits (texts of 0 and 1) of each key, however the bits fall into blocks."""
    return carried(blocks, keys, [*order, bits, reset], Deframe(rules), FRAMES, order)


#: What ``FollowHops`` gives: the transmission's number, channel and times of its best copy, its payload and number of copies.
HOPS = "seq long, channel long, start_us long, end_us long, payload string, rank int, copies int"


class FollowHops:
    """The frames of all channels of a hopper as one stream in the order of their ends, each transmission once.

    Rows: end_us, start_us, channel, rank (0 is best), payload. A frame is a copy if a channel that the transmission
    hasn't been heard on has the same payload within ``within`` of the end of the transmission's first frame; the copy of the least
    rank is given, the earliest of equals. A repeat on one channel is a transmission of its own. Transmissions leave
    once no copy can follow, so the state is what ended in the last ``within``.
    """

    def __init__(self, within: int = 500_000):
        self.within = within

    def start(self) -> dict:
        return {"seq": 0, "open": []}

    def _leave(self, state: dict) -> tuple:
        one = state["open"].pop(0)
        state["seq"] += 1
        return (state["seq"], *one["best"], len(one["heard"]))

    def step(self, state: dict, row: tuple) -> Iterator[tuple]:
        end, start, channel, rank, payload = row
        while state["open"] and end - state["open"][0]["end"] > self.within:
            yield self._leave(state)
        best = [channel, start, end, payload, rank]
        same = [one for one in state["open"] if one["best"][3] == payload]
        if not same or channel in same[-1]["heard"]:  # the newest transmission of a payload takes its copies
            state["open"].append({"end": end, "heard": [channel], "best": best})
            return
        same[-1]["heard"].append(channel)
        if rank < same[-1]["best"][4]:
            same[-1]["best"] = best

    def end(self, state: dict) -> Iterator[tuple]:
        while state["open"]:
            yield self._leave(state)


HOP_COLUMNS = ["end_us", "start_us", "channel", "rank", "payload"]


def follow_hops(frames: DataFrame, keys: list[str], within: int = 500_000) -> DataFrame:
    """keys and ``HOPS`` of each hopper's frames (``HOP_COLUMNS``)."""
    return carried(frames, keys, HOP_COLUMNS, FollowHops(within), HOPS)
