"""Plain versions of the operators' rules, for small inputs."""

import hashlib
import re

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, ok in (
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return out


def secrets(text):
    found = []
    for k, (kind, pattern, flags, ok) in enumerate((
        ("assign", ASSIGN, re.I | re.A, lambda m: len(m[2]) >= 12), ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
    )):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if ok(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
