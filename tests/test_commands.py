"""Commands by their grammar: what proves a test, build or lint run, and what only looks like one."""

import pytest

from tracemill.functions import commands as c

PROVEN = [
    ("go test ./a", "go:test", "package", "test"), ("go test", "go:test", ".", "test"), ("go test .", "go:test", "package", "test"), ("go test ./A", "go:test", "other", "test"), ("go test ./... ./X", "go:test", "package", "test"),
    ("/usr/local/bin/GO TEST -v -race pkg/b/...", "go:test", "package", "test"), ("go test -run 'A|B' -count=3 \"./a b\"", "go:test", "other", "test"), ("go test -timeout 5m -p 2 a", "go:test", "package", "test"),
    ("go test -run '^$' ./a", "go:test", "package", "test"), ("go test -bench . ./a", "go:test", "package", "test"), ("go test -run ^\\$ -run X -bench . a", "go:test", "package", "test"), ("go test -v=false -", "go:test", ".", "test"),
    ("go test -count +07 a", "go:test", "package", "test"), ("go build -ldflags '-s -w' ./a", None, None, None), ("go build -ldflags='-s -w' ./a", "go:build", "package", "build"), ("go build -trimpath", "go:build", ".", "build"),
    ("go vet -tags=x,y ./...", "go:vet", "package", "lint"), ("npm test", "npm:test", "npm:test", "test"), ("npm run lint", "npm:lint", "npm:lint", "lint"), ("\tnpm  RUN build ", "npm:build", "npm:build", "build"),
    ("npm test -- --runInBand", "npm:test", "npm:test", "test"), ("npm test a -- --runInBand --runInBand", "npm:test", "npm:test", "test"), ("npm run test --", "npm:test", "npm:test", "test"), ("g\\o te'st' \"./a\"", "go:test", "package", "test"),
]
UNPROVEN = [
    "go test -h", "go test --help ./a", "go test -list X ./a", "go test -c", "go test -count 0 a", "go test -count=00", "go test -count=x a", "go test -count=", "go test -count", "go test -count -v", "go test -count=99999999999999999999 a",
    "go test -exec=x a", "go test -toolexec x a", "go test -later a", "go test -- a", "go test -run '^$' -bench X a", "go test -bench=X -run='$^'", "go test -run", "go test -run -v", "go build -n a", "go build -run X a", "go vet -cover", "npm test x",
    "npm test --dry-run", "npm test --ignore-scripts true", "npm run test --watch", "npm test -- --list", "npm test -- --runInBand x", "npm test -", "npm run lint - -- --runInBand", "npm run lint fix",
]
OTHER = [
    "go test ./a | tail", "go test; true", "go test && x", "go test &", "go test > f", "go test $(x)", "go test `x`", "go test\nx", "go test *", "go test a?", "go test [a]", "go test {a}", "go test # x", "go test 'open", 'go test "$X"', 'go test "a\\b"',
    "go test a\\", "", "  ", None, "ls -l", "'' test", "go test " + "x" * 513, "go test " + "x " * 127, "go test" + " " * 4090, "go test \x00", "gö test",
]
GIT = {
    "git status --porcelain=v1 --branch": ("git:status", "status"), "git status --branch --porcelain=v1": ("git:status", "status"), "git status --branch --branch": ("git:other", None), "git status": ("git:other", None), "git rev-parse HEAD": ("git:head", "head"),
    "git rev-parse head": ("git:other", None), "git branch --show-current": ("git:branch", "branch"), "git describe --exact-match '--tags'": ("git:tag", "tag"), "git push": ("git:other", None), "git": ("git:other", None), "npm help test": ("npm:other", None),
    "npm run Test": ("npm:other", None), "npm run": ("npm:other", None), "go": ("go:other", None), "go/ mod": ("go:other", None),
}


@pytest.fixture(scope="module")
def classified(spark):
    texts = [x[0] for x in PROVEN] + UNPROVEN + OTHER + list(GIT)
    frame = spark.createDataFrame([(t,) for t in texts], "x string").select("x", c.classify_command("x").alias("c"))
    return {r.x: tuple(r.c) for r in frame.collect()}


@pytest.mark.parametrize("command,signature,component,kind", PROVEN)
def test_proven(classified, command, signature, component, kind):
    assert classified[command] == (signature or "go:build", component, kind, None)


def test_unproven(classified):
    assert {x: classified[x] for x in UNPROVEN if classified[x][1:] != (None, None, None)} == {} and {classified[x][0] for x in UNPROVEN} == {"go:test", "go:build", "go:vet", "npm:test", "npm:lint"}


def test_other(classified):
    assert {x: classified[x] for x in OTHER if classified[x] != ("other", None, None, None)} == {}


def test_git(classified):
    assert {x: (classified[x][0], classified[x][3]) for x in GIT} == GIT and all(classified[x][1:3] == (None, None) for x in GIT)


def test_words(spark):
    texts = ["a 'b c'\td\\ e \"f'g\"h", "''", "é\\é", "a" * 512 + " b", "é" * 257, "\\'" * 200, "'" + "a" * 3000 + "'", "a" * 100 + " '" * 1000 + "'"]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", c.shell_words("x").alias("w")).orderBy("i").collect()]
    assert got == [["a", "b c", "d e", "f'gh"], [""], ["éé"], ["a" * 512, "b"], None, ["'" * 200], None, None]
