"""Secrets in forms of many languages, held apart from how the lexer was written, and texts that once took quadratic time."""

from __future__ import annotations

import time

import pytest

from grovekit.llm import secrets

K = "Zk3v9QpL8xW2"


def literals(text):
    return [text[a:b] for k, a, b in secrets.scan(text) if k == "literal"]


@pytest.mark.parametrize("text", [
    f'os.getenv("API_KEY", "{K}")', f'#define PASSPHRASE "{K}"', f'passphrase = """{K}"""', f"passphrase = '''{K}'''", f'a, passphrase = "x", "{K}"', f'passphrase = c ? "{K}" : "q"', f'passphrase = x if c else "{K}"',
    f'passphrase = /* c */ "{K}"', f'passphrase = # note\n    "{K}"', f'passphrase = // note\n    "{K}"', f'passphrase: &x "{K}"', f'setPassword("{K}")', f'conf.set_password("{K}", 3)', f'passphrase = env.X || "{K}"',
])
def test_forms(text):
    assert literals(text) == [K]


def test_more_than_one_literal():
    assert literals('pwd = "Zk3v9QpL" "8xW2mN5b"') == ["Zk3v9QpL", "8xW2mN5b"]
    assert literals(f'passphrase = f"{K}{{x}}"') == [K + "{x}"]
    assert literals('passphrase = c ? "Zk3v9QpL8xW2" : "Qk7v1QpL9xW4"') == ["Zk3v9QpL8xW2", "Qk7v1QpL9xW4"]


#: Snippets with the literals that are secrets, if any. None was used while the lexer was written.
LABELLED = [
    ('const authToken: string = "q8Zt4LmX0vBn";', ["q8Zt4LmX0vBn"]), ("private static final String DB_PASSPHRASE = \"tR5_kW9zQ2eJ\";", ["tR5_kW9zQ2eJ"]), ("let accessKey = 'm3Xp7RtY1cVb';", ["m3Xp7RtY1cVb"]), ("credentials:\n  pwd: 'h7Gf2KjL9dSa'\n", ["h7Gf2KjL9dSa"]),
    ('{"auth": {"signatureKey": "Wn4Bv8Xc1Zq6"}}', ["Wn4Bv8Xc1Zq6"]), ('$passphrase = "Yt5Re3Wq9Uo1";', ["Yt5Re3Wq9Uo1"]), ("export DB_PASS=Jk8Lm2Np5Qr7", ["Jk8Lm2Np5Qr7"]), ('<passphrase>Hg6Fd3Sa9Kl2</passphrase>', ["Hg6Fd3Sa9Kl2"]),
    ('val privateKey = "Vb7Nm4Kj1Hg8" + "Fd2Sa5Qw9Er3"', ["Vb7Nm4Kj1Hg8", "Fd2Sa5Qw9Er3"]), ('conn = connect(host="db", pwd="Xc3Vb6Nm9Lk2")', ["Xc3Vb6Nm9Lk2"]), ("passphrase := `Po4Iu7Yt2Re9`", ["Po4Iu7Yt2Re9"]), ("static const char *passphrase = \"Mn8Bv5Cx2Zl4\";", ["Mn8Bv5Cx2Zl4"]),
    ("[db]\npwd = Gt5Hy7Ju9Ki3\n", ["Gt5Hy7Ju9Ki3"]), ('config["passphrase"] = "Rf4Tg6Yh8Uj1"', ["Rf4Tg6Yh8Uj1"]), ("@pwd = 'Ed3Rf5Tg7Yh9'", ["Ed3Rf5Tg7Yh9"]), ('k = "Ws2Ed4Rf6Tg8"\nprivate_key = k\n', ["Ws2Ed4Rf6Tg8"]), ('client.withPassphrase("Qa1Ws3Ed5Rf7")', ["Qa1Ws3Ed5Rf7"]),
    ('"pwd" => "Zx9Cv7Bn5Mk3",', ["Zx9Cv7Bn5Mk3"]), ("ENV DB_PWD Lk3Jh5Gf7Ds9", ["Lk3Jh5Gf7Ds9"]), ('System.setProperty("db.pwd", "Uy6Tr4Ew2Qa8");', ["Uy6Tr4Ew2Qa8"]), ("curl -H 'X: 1' --pwd=Bn4Mk6Jh8Gf2", ["Bn4Mk6Jh8Gf2"]), ("passphrase = [\n  'Nb5Vc7Xz9Lk1',\n]", ["Nb5Vc7Xz9Lk1"]),
    ('color = "a1B2c3D4e5F6"', []), ('passphrase_field = "input-field-12"', []), ('log.info("pwd changed for user")', []), ('keyName = "Primary1Key2Name"', []), ('passphrase = os.environ["X"]', []), ('passphrase = ""', []), ('pwd = "changeme1234"', []), ("monkey = 'Zk3v9QpL8xW2'", []),
    ('if pwd == "x": return', []), ('url = "https://example.org/Abc123Def"', []), ('public_key_id = "K1234567ab"', []), ("# the key to good prose = patience", []), ('version = "1.24.3-beta+exp"', []), ('print("enter passphrase: ")', []), ('sha = "W2x9"', []), ("passphrase = <your passphrase>", []), ('hashtag = "Zk3v9QpL8xW2"', []),
    ('def check(pwd): return len(pwd) > 8', []), ('labels = {"keyword": "Abc12Def34"}', []), ("path_to_key = '/etc/ssl/K1.pem'", []),
]


def test_labelled_snippets():
    hit = found = true = 0
    for text, want in LABELLED:
        got = literals(text)
        hit, found, true = hit + len(set(got) & set(want)), found + len(got), true + len(want)
    assert hit / true >= 0.9 and hit / found >= 0.9, (hit, found, true)


@pytest.mark.parametrize("text", [
    'key = "a"\n' + 'key = key + "abcd1234"\n' * 40_000,
    '{"' + "secret " * 8000 + '": {' + ",".join(f'"m{i}": "v{i}"' for i in range(60_000)) + "}}",
    "passphrase = /* " * 60_000, "passphrase = # " * 60_000, "f(" * 200_000, 'setPassword("x",' * 60_000, "a, " * 300_000 + "= 1", '"""' * 300_000,
], ids=["chain", "owner", "open comments", "notes", "open calls", "setters", "tuple", "quotes"])
def test_time_is_linear(text):
    began = time.process_time()
    secrets.scan("secret " + text)
    assert time.process_time() - began < 12  # about 5 s at most on one core that has nothing else to do
