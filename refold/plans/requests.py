"""What to undo along one axis, checked and brought to a canonical key."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

from refold.functions.borders import BORDERS
from refold.functions.kernels import Kernel

MODES = ("auto", "f32", "f64")


@dataclass(frozen=True)
class Request:
    """source_size samples were made from destination_size ones: sample r lies at
    (r + 0.5) / (source_size / active_length) + shift. mode: the precision of the solution."""

    source_size: int
    destination_size: int
    active_length: float
    shift: float
    kernel: Kernel
    border: str = "symmetric"
    mode: str = "auto"

    def __post_init__(self):
        if self.source_size <= 0 or self.destination_size <= 0:
            raise ValueError("axis dimensions must be positive")
        if not (self.active_length > 0 and isfinite(self.active_length) and isfinite(self.shift)):
            raise ValueError("active length and shift must be finite, with positive active length")
        if self.border not in BORDERS:
            raise ValueError("padding mode is invalid")
        if self.mode not in MODES:
            raise ValueError("f64 mode is invalid")
        if not 1 <= self.kernel.support <= (2**31 - 2) // 2:
            raise ValueError("filter support is invalid or too large")

    @property
    def key(self) -> tuple:
        return (self.source_size, self.destination_size, float(self.active_length).hex(), float(self.shift).hex(), self.kernel.key, self.border, self.mode)

    @property
    def half_bandwidth(self) -> int:
        return min(2 * self.kernel.support - 1, self.destination_size - 1)


def axis(source: int, destination: int, kernel: Kernel, active: float | None = None, shift: float = 0.0, border: str = "symmetric", mode: str = "auto") -> Request:
    return Request(source, destination, float(destination if active is None else active), float(shift), kernel, border, mode)
