"""Planted secrets in many ways of writing them: precision, recall and time."""

import random
import time

import pytest

from sigloom.llm import secrets

TICKS = "'" * 3
#: Ways to write a secret {v} (or its halves {a}, {b}) in code and configuration, each for a name {n}.
WAYS = [
    '{n} = "{v}"',
    "{n}: '{v}'",
    "{n}={v}",
    'K={v}\nexport {n}="$K"',
    "K={v}\n{n}=$K",
    "K='{v}'\n{n}=${{K}}",
    '{n} = """{v}"""',
    "{n} = " + TICKS + "\n  {v}\n" + TICKS,
    "{n}: |\n  {v}\nother: 1",
    "  {n}: >-\n    {a}\n    {b}\n",
    '<add key="{n}" value="{v}"/>',
    '{{"name": "{n}", "value": "{v}"}}',
    'k = "{a}"\n{n} = k + "{b}"',
    '{n} = "{a}" + "{b}"',
    'k = "{v}"; {n} = k',
    'k = "{a}"\n{n} = f"{{k}}{b}"',
    "{n} := `{v}`",
    '"{n}" => "{v}"',
    'conf["{n}"] = "{v}"',
    'u = "{v}"\nw = u\n{n} = w',
]
NAMES = ["db_password", "authToken", "API_KEY", "client.secret", "dbPwd", "session-key", "privateKey", "passphrase"]
#: Assignments that hold no secret, some with a random value for a plain name {p}.
CLEAN = [
    '{p} = "{v}"',
    "{n} = fetch(k)",
    '{n} = "changeme-example-1"',
    "{n}: enter your value",
    "if {n} == other: pass",
    '{p}: "a longer text, with words"',
    "{p} = k + 'x'",
    '<add key="{p}" value="{v}"/>',
    "K={v}\n{p}=$K",
    '{n} = "{{{{placeholder}}}}"',
]
LETTERS = "abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def value(rng):
    return "".join(rng.choice(LETTERS) for _ in range(20)) + "q7Z"


def test_planted_secrets():
    """Precision and recall with values and names that no pattern knows."""
    rng = random.Random(17)
    hit = planted = wrong = 0
    for k in range(1000):
        v = value(rng)
        a, b = v[:11], v[11:]
        text = f"line {k}\n" + WAYS[k % len(WAYS)].format(n=rng.choice(NAMES), v=v, a=a, b=b) + "\nend"
        found = [text[s:e] for _, s, e, _ in secrets.find(text)]
        wanted = [v] if v in text else [a, b]
        planted += len(wanted)
        hit += sum(any(w in f for f in found) for w in wanted)
        clean = f"line {k}\n" + CLEAN[k % len(CLEAN)].format(n=rng.choice(NAMES), p=rng.choice(["color", "title", "path", "width_label"]), v=value(rng)) + "\nend"
        wrong += sum(not s[3] for s in secrets.find(clean))
    assert hit / planted > 0.98 and hit / (hit + wrong) > 0.98, (hit, planted, wrong)


@pytest.mark.parametrize("unit", ['k = k + "a1B"\n', 'k = f"{k}{k}"\n', "p: |\n x\n", 'password = """', "a=" + TICKS + "x" + TICKS + "\n", 'name="a" value="b" ', "K=$K$K\n", "a: |\n"])
def test_constants_cost_linear_time(unit):
    took = []
    for n in (4000, 16_000):
        began = time.perf_counter()
        secrets.find("k = 'seed1234'\n" + unit * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5, took


def test_where_a_constant_stands():
    """Spans lie on the literal, wherever it was bound; a name that is called or unknown gives none."""
    for text, want in [
        ('A = "hG7kd02mm"\nauth_key = A + "ZqP1xa88" + A', ["hG7kd02mm", "ZqP1xa88"]),
        ("K=hG7kd02mmZqP1xa\nK=other\nPASSWORD=$K", []),
        ('authKey = k + "ab"', []),
        ('k = "hG7kd02mmZqP1xa"\nauthKey = k(3)', []),
        ('<a key="color" value="hG7kd02mmZqP1xa"/>', []),
        ("auth:\n  key: |\n  hG7kd02mm1\n", []),
    ]:
        assert [text[s:e] for _, s, e, base in secrets.find(text) if not base] == want, text
