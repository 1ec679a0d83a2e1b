"""A small made-up package, its tests and its docs, as (path, text): input of the code queries."""

FILES = [
    (
        "src/shop/__init__.py",
        '''"""A toy shop."""

from .cart import Cart, total_price
from .pricing import discount

__all__ = ["Cart", "discount", "open_shop"]

VERSION = "1.2"


def open_shop(name: str = "corner") -> "Cart":
    """Open a shop and hand out a cart."""
    cart = Cart(name)
    cart.add("bread", 2)
    return cart
''',
    ),
    (
        "src/shop/cart.py",
        '''"""Carts."""

import json
from . import pricing
from .base import Holder, Loud
from .pricing import discount

LIMIT: int = 50
Alias = Holder


class Cart(Holder):
    """Holds items."""

    kind = "cart"

    def __init__(self, owner: str):
        self.owner = owner
        self.items: list = []

    def add(self, item: str, count: int = 1) -> int:
        """Put an item in."""
        self.items.append((item, count))
        return len(self.items)

    @property
    def size(self) -> int:
        return len(self.items)

    def load(self, text: str) -> "Cart":
        for k, v in json.loads(text).items():
            self.add(k, v)
        return self

    def _unused(self) -> None:
        return None


class Siren(Loud, Cart):
    def ring(self) -> str:
        return "ring"


def total_price(cart: Cart, rate: float = 0.1) -> float:
    """Add up a cart."""

    def one(line):
        return pricing.price_of(line[0]) * line[1]

    whole = sum(map(one, cart.items))
    return discount(whole, rate)


def forgotten(x: int) -> int:
    """Nobody calls this."""
    return forgotten(x - 1) if x else 0


def _private_dead(cart: Cart) -> float:
    return total_price(cart)
''',
    ),
    (
        "src/shop/pricing.py",
        '''"""Prices."""

from .util import lookup
from shop import cart as _cart

HANDLERS = {"plain": "plain_rule", "bulk": None}


def price_of(item: str) -> float:
    return lookup(item)


def discount(amount: float, rate: float) -> float:
    """Take a share off."""
    if amount > 100:
        return plain_rule(amount, rate)
    return amount


def plain_rule(amount: float, rate: float) -> float:
    return amount * (1 - rate)


def callback(fn=discount, *extra: str, **more: int) -> list:
    return [fn, len(extra), more]
''',
    ),
    (
        "src/shop/base.py",
        '''"""Base classes."""

from abc import ABC, abstractmethod
from typing import Protocol


class Holder(ABC):
    """Keeps things."""

    @abstractmethod
    def add(self, item, count=1):
        """Put an item in."""

    def ring(self) -> str:
        return ""


class Loud(Protocol):
    def ring(self) -> str: ...


class Stray:
    """Never used."""

    def walk(self) -> int:
        return 1
''',
    ),
    (
        "src/shop/util.py",
        '''"""Helpers."""

import os.path
from collections import OrderedDict as OD

TABLE = OD(bread=1.5)


def lookup(item: str) -> float:
    return TABLE.get(item, default())


def default() -> float:
    return 1.0


async def fetch(url: str, timeout: float = 1.0) -> bytes:
    return await get(url)


def walk(path):
    return os.path.split(path)


if __name__ == "__main__":
    print(lookup("bread"))
''',
    ),
    (
        "src/shop/web.py",
        '''"""Routes."""

from shop.cart import Cart, total_price
from shop.missing import nothing


@app.get("/total")
def show_total(name: str) -> float:
    return total_price(Cart(name))


@app.command
def run() -> None:
    show_total("x")
''',
    ),
    (
        "tests/test_cart.py",
        '''from shop.cart import Cart, total_price


def test_total():
    cart = Cart("me")
    cart.add("bread")
    assert total_price(cart) > 0


def test_size():
    cart = Cart("me")
    cart.add("bread")
    assert cart.size == 1


def test_size_again():
    cart = Cart("me")
    cart.add("bread")
    assert cart.size == 1
''',
    ),
    ("tests/test_pricing.py", "from shop import pricing\n\n\ndef test_discount():\n    assert pricing.discount(10, 0.5) == 10\n"),
    ("src/shop/broken.py", "def oops(:\n"),
    ("src/shop/empty.py", ""),
]

DOCS = [
    ("README.md", "# Shop\n\nUse `open_shop` to begin.\n\n## Cart\n\nThe `Cart` holds items.\n\n```python\ndef total_price(cart: Cart, rate: float = 0.2) -> float\n```\n\n### Discount\n\n> quoted\nTake a share off with `discount`.\n"),
    ("docs/guide.md", "# Guide\n\nStart with bread.\n\n## total_price\n\nAdds up a `Cart` at a rate.\n\n```python\ndef discount(amount: float, rate: float) -> float\n```\n"),
    ("docs/howto.md", "# How to\n\n## Cart\n\nSee the guide.\n\n#### deep\n\ntext\n"),
]

