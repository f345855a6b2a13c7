import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "0123abcdef", "x", "é", "\n", "abcdefgh"]), max_size=14).map("".join))
def test_base_spans_by_brute_force(text):
    assert [s[:3] for s in secrets.find(text) if s[0] != "literal"] == plain(text)


def test_query_by_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for row in queries.op7_secrets(spark, small).collect():
        spans = plain(texts[row["doc_id"]] or "")
        line = ",".join("%s:%d:%d" % s for s in spans)
        assert row["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert row["n_assign"] == sum(s[0] == "assign" for s in spans)
        assert not line or set(line.split(",")) <= set(row["spans"].split(","))


def test_constants_reach_sensitive_names():
    text = 'KEY_PART = "Zx81-qqPw77"\nclient_secret = KEY_PART\n'
    assert [s[:3] for s in secrets.find(text) if s[0] == "literal"] == [("literal", 12, 23)]
    assert not [s for s in secrets.find('title = "Zx81-qqPw77"\n') if s[0] == "literal"]
    assert not [s for s in secrets.find('private_key = "$VARIABLE_NAME1"\n') if s[0] == "literal"]


def test_names_of_any_length_subscripts_and_types():
    value = "Zx81-qqPw77"
    long = "spring.security.saml2.relyingparty.registration.okta.signing.credentials"
    assert len(long) > 64
    for target in (f"{long}=", "a." * 5_000 + "pwd = ", f'"{"x-" * 40}pwd": ', 'os.environ["DB_PWD"] = ', "config['db'][ 'pwd' ] = ", "pwd[0] = ", "credentials[name]=", "pwd: str = ", "let pwd: string | null = ", "const PWD: &'static str = ", "pwd: std::string::String = ", "pwd: Optional[str] = ", "note: pwd = "):
        text = f'x = 1\n{target}"{value}"\n'
        at = text.index(value)
        assert [s[:3] for s in secrets.find(text) if s[0] == "literal"] == [("literal", at, at + len(value))], target
    for target in ('os.environ["HOME"] = ', "title: str = ", "pwd: str\ntitle = ", "9pwd = ", "pwd: list = x; title = ", "title" * 100 + " = "):
        assert not [s for s in secrets.find(f'{target}"{value}"\n') if s[0] == "literal"], target


def test_syntax_that_needs_a_lexer():
    value = "a8Fk29xLmQ7pZ1vB"
    for text in (f'credential = (\n    "{value}"\n)', f'credential = \\\n  "{value}"', f'a = "{value}"\nif a == "b":\n    pass\ncredential = a', f"# pwd = {value}", f"/* pwd = '{value}' */", f"don't use pwd = {value}, it's known", f'dsn = "Server=x;Pwd={value};"', f"<passphrase>{value}</passphrase>", f"pwd ?= {value}", f"pwd := `{value}`", f"'pwd' => '{value}'", f'a = b"{value}"\npwd=a', f'pwd = """{value}"""', "pwd" + " " * 100 + f'= "{value}"', "x" * 70 + f'_credential = "{value}"'):
        at = text.index(value)
        assert [s[:3] for s in secrets.find(text) if s[0] == "literal"] == [("literal", at, at + len(value))], text
    for text in (f'if credential == "{value}":', f'if credential != "{value}":', f'if pwd <= "{value}":', f'title = "pwd"\nother = "{value}"', f'# a = "{value}"\npwd = a', f'pwd()\nx = "{value}"', f'title = "{value}"  # pwd'):
        assert not [s for s in secrets.find(text) if s[0] == "literal"], text


def test_added_spans_by_construction():
    """Programs are put together from assignments whose names and literals are known; the spans follow from those."""
    draw = random.Random(6)
    value = lambda: "".join(draw.choices("abcdefgh", k=5)) + "".join(draw.choices("XYZQRSTU", k=5)) + "".join(draw.choices("0123456789", k=6))
    forms = ('{n} = "{v}"', "{n}: '{v}'", 'const {n} = "{v}";', '{n}: str = "{v}"', '"{n}": "{v}",', 'conf["{n}"] = "{v}"', "{n} := `{v}`", "{n} = (\n  '{v}'\n)", "<{n}>{v}</{n}>", "self.{n}={v}", "// {n} = '{v}'", '{n} => "{v}"')
    for _ in range(300):
        text, expected, held = "", set(), {}
        for line in range(draw.randrange(1, 12)):
            kind = draw.random()
            if kind < 0.5:
                sensitive = draw.random() < 0.5
                name = draw.choice(["pwd", "db_pwd", "userCredential", "signing_key", "passphrase"] if sensitive else ["title", "colour", "host_name", "sizes"]) + ("" if sensitive else str(line))
                form, v = draw.choice(forms), value()
                part = form.format(n=name, v=v)
                if sensitive:
                    at = len(text) + part.index(v)
                    expected.add((at, at + len(v)))
            elif kind < 0.7:
                name, v = f"const{line}", value()
                part = f'{name} = "{v}"'
                at = len(text) + part.index(v)
                held[name] = (at, at + len(v))
            elif kind < 0.8 and held:
                name = draw.choice(sorted(held))
                part = f"client_pwd = {name}"
                expected.add(held[name])
            else:
                part = draw.choice(["It's plain prose, isn't it?", f'if pwd == "{value()}":', f'print("{value()}")', f"see {value()}", 'x = "it\'s"', "y = 'say \"no\"'", "# it's a note", "/* don't */"])
            text += part + "\n"
        found = {s[1:3] for s in secrets.find(text) if s[0] == "literal"}
        assert found == expected, text


def test_names_take_linear_time():
    begun = time.process_time()
    for text in ("a" * 1_000_000 + "=x", "a:" * 300_000, "a[b]" * 200_000 + "=x", '["=' * 200_000, "a::" * 200_000, "a: b " * 200_000 + "= x", " " * 1_000_000 + "=x", '"]=' * 200_000):
        secrets.pairs(text)
    assert time.process_time() - begun < 30


def test_odd_rows(odd, none):
    assert secrets.digest(odd).count() == 12
    assert secrets.digest(none).count() == 0
    assert secrets.detect(odd).count() == 12
