"""Random draws that any engine can repeat: modular multiplications of a whole number."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def uniform(number: Column, salt: int, seed: int = 0) -> Column:
    """A draw in (0, 1) that depends on the number, the salt and the seed alone."""
    a = F.pmod(F.pmod(number, F.lit(1_000_000_007)) * 48271 + F.lit(salt * 69621 + seed * 30269 + 1013904223), F.lit(PRIME))
    b = F.pmod(a * 48271 + F.pmod(number, F.lit(65521)), F.lit(PRIME))
    return (F.pmod(b * 16807 + F.lit(salt), F.lit(PRIME)) + 0.5) / float(PRIME)


def uniform_of(number: np.ndarray, salt: int, seed: int = 0) -> np.ndarray:
    """``uniform`` on an array of whole numbers, bit for bit."""
    a = (number % 1_000_000_007 * 48271 + (salt * 69621 + seed * 30269 + 1013904223)) % PRIME
    b = (a * 48271 + number % 65521) % PRIME
    return ((b * 16807 + salt) % PRIME + 0.5) / float(PRIME)
