"""Names that a language brings along: standard libraries and builtins, as small tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.names import SCRIPT_LANGUAGES

# Packages of the standard libraries, and builtin names.
GO = """
archive/tar archive/zip bufio bytes cmp compress/bzip2 compress/flate compress/gzip compress/lzw compress/zlib container/heap
container/list container/ring context crypto crypto/aes crypto/cipher crypto/des crypto/dsa crypto/ecdh crypto/ecdsa crypto/ed25519
crypto/elliptic crypto/hmac crypto/md5 crypto/rand crypto/rc4 crypto/rsa crypto/sha1 crypto/sha256 crypto/sha512 crypto/subtle crypto/tls
crypto/x509 crypto/x509/pkix database/sql database/sql/driver debug/buildinfo debug/dwarf debug/elf debug/gosym debug/macho debug/pe
debug/plan9obj embed encoding encoding/ascii85 encoding/asn1 encoding/base32 encoding/base64 encoding/binary encoding/csv encoding/gob
encoding/hex encoding/json encoding/pem encoding/xml errors expvar flag fmt go/ast go/build go/build/constraint go/constant go/doc
go/doc/comment go/format go/importer go/parser go/printer go/scanner go/token go/types go/version hash hash/adler32 hash/crc32 hash/crc64
hash/fnv hash/maphash html html/template image image/color image/color/palette image/draw image/gif image/jpeg image/png index/suffixarray
io io/fs io/ioutil log log/slog log/syslog maps math math/big math/bits math/cmplx math/rand math/rand/v2 mime mime/multipart
mime/quotedprintable net net/http net/http/cgi net/http/cookiejar net/http/fcgi net/http/httptest net/http/httptrace net/http/httputil
net/http/pprof net/mail net/netip net/rpc net/rpc/jsonrpc net/smtp net/textproto net/url os os/exec os/signal os/user path path/filepath
plugin reflect regexp regexp/syntax runtime runtime/cgo runtime/coverage runtime/debug runtime/metrics runtime/pprof runtime/trace slices
sort strconv strings sync sync/atomic syscall testing testing/fstest testing/iotest testing/quick testing/slogtest text/scanner
text/tabwriter text/template text/template/parse time time/tzdata unicode unicode/utf16 unicode/utf8 unsafe
"""
SCRIPT = "assert buffer child_process crypto events fs fs/promises http https os path stream timers url util zlib node:fs node:path node:url"
JAVA = "java.lang java.util java.io java.net java.nio java.time java.math java.sql java.text javax.crypto javax.net"
RUST = "std std::alloc std::borrow std::cmp std::collections std::env std::fmt std::fs std::io std::path std::str std::sync std::thread std::time core alloc"
PYTHON = """
abc aifc argparse array ast asyncio atexit base64 bdb binascii bisect builtins bz2 calendar cgi cgitb chunk cmath cmd code codecs
collections colorsys compileall concurrent configparser contextlib copy copyreg crypt csv ctypes curses dataclasses datetime dbm decimal
difflib dis distutils doctest email encodings enum errno faulthandler fcntl filecmp fileinput fnmatch fractions ftplib functools gc getopt
getpass gettext glob graphlib grp gzip hashlib heapq hmac html http imaplib imghdr imp importlib inspect io ipaddress itertools json
keyword lib2to3 linecache locale logging lzma mailbox mailcap marshal math mimetypes mmap modulefinder multiprocessing netrc nis nntplib
numbers operator optparse os ossaudiodev parser pathlib pdb pickle pickletools pipes pkgutil platform plistlib poplib posix posixpath
pprint profile pstats pty pwd py_compile pyclbr pydoc queue quopri random re readline reprlib resource rlcompleter runpy sched secrets
select selectors shelve shlex shutil signal site smtpd smtplib sndhdr socket socketserver spwd sqlite3 ssl stat statistics string
stringprep struct subprocess sunau symtable sys sysconfig syslog tabnanny tarfile tempfile termios test textwrap threading time timeit
tkinter token tokenize tomllib trace traceback tracemalloc tty turtle turtledemo types typing unicodedata unittest urllib uu uuid venv
warnings wave weakref webbrowser winreg winsound wsgiref xdrlib xml xmlrpc zipapp zipfile zipimport zlib
"""
PYTHON_BUILTINS = """
abs aiter all anext any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod
enumerate eval exec filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list
locals map max memoryview min next object oct open ord pow print property range repr reversed round set setattr slice sorted staticmethod
str sum super tuple type vars zip __import__
"""
GO_BUILTINS = """
append cap close complex copy delete imag len make new panic print println real recover bool byte complex64 complex128 error float32
float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr nil true false iota
"""


def stdlib_names() -> dict[str, set[str]]:
    """Library names by language: full ones, and the parts by which code refers to them."""
    go = {n for p in GO.split() for n in (p, p.rsplit("/", 1)[-1])}
    python = {n for p in PYTHON.split() for n in (p, p.split(".", 1)[0])}

    def parts(text: str) -> set[str]:
        return {x for p in text.split() for x in (p, *re.split("[/.:]+", p)) if x}

    script = parts(SCRIPT)
    return {"go": go, "python": python, **dict.fromkeys(SCRIPT_LANGUAGES, script), "java": parts(JAVA), "rust": parts(RUST)}


def stdlib(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted((lang, n) for lang, names in stdlib_names().items() for n in names), "language string, name string")


def builtins(spark: SparkSession) -> DataFrame:
    rows = [("python", n) for n in PYTHON_BUILTINS.split()] + [("go", n) for n in GO_BUILTINS.split()]
    return spark.createDataFrame(rows, "language string, name string")
