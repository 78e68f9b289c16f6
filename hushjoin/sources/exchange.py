"""Keys and exchange settings, all on the driver. Elliptic-curve and AES work is done by the JVM's own providers.

An exchange document is a JSON JWE with two recipients (ECDH-ES+A256KW, A256GCM). Its payload holds the hashing
secret, both public keys and an exchange id, from which both sides derive the same transport key. Labels that
deployments choose (document type, derivation info, key folder) are parameters.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import secrets
import stat
import struct
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime, timezone
from pathlib import Path

CURVES = {"P-256": "secp256r1", "P-384": "secp384r1", "P-521": "secp521r1"}
VERSIONS = {1}
TYPE, CONTENT = "hushjoin-exchange+jwe", "application/hushjoin-exchange+json"
INFO = b"hushjoin:token-encryption:v1"
KEY_FOLDER = "~/.hushjoin"


def _jvm():
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is None:
        raise RuntimeError("a Spark session is needed: its JVM does the cryptography")
    return sc._jvm


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def _unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def _pem(kind: str, der: bytes) -> bytes:
    body = base64.b64encode(der).decode()
    lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
    return f"-----BEGIN {kind} KEY-----\n{lines}\n-----END {kind} KEY-----\n".encode()


def _der(pem: bytes | str) -> bytes:
    text = pem.decode() if isinstance(pem, bytes) else pem
    return base64.b64decode("".join(x for x in text.splitlines() if "-----" not in x))


def _private(pem: bytes):
    j = _jvm()
    return j.java.security.KeyFactory.getInstance("EC").generatePrivate(j.java.security.spec.PKCS8EncodedKeySpec(bytearray(_der(pem))))


def _public(pem: bytes | str):
    j = _jvm()
    return j.java.security.KeyFactory.getInstance("EC").generatePublic(j.java.security.spec.X509EncodedKeySpec(bytearray(_der(pem))))


def _curve_params(curve: str):
    j = _jvm()
    p = j.java.security.AlgorithmParameters.getInstance("EC")
    p.init(j.java.security.spec.ECGenParameterSpec(CURVES[curve]))
    return p.getParameterSpec(j.java.lang.Class.forName("java.security.spec.ECParameterSpec"))


def _spec(key, name: str):
    """A key as a public specification class: the providers' own key classes are closed to calls from outside."""
    j = _jvm()
    return j.java.security.KeyFactory.getInstance("EC").getKeySpec(key, j.java.lang.Class.forName(f"java.security.spec.{name}"))


def _field_size(key) -> int:
    name = "ECPrivateKeySpec" if key.getClass().getName().endswith("ECPrivateKeyImpl") else "ECPublicKeySpec"
    return _spec(key, name).getParams().getCurve().getField().getFieldSize()


def _curve_of(key) -> str:
    return {256: "P-256", 384: "P-384", 521: "P-521"}[_field_size(key)]


def generate_key_pair(curve: str = "P-256") -> tuple[bytes, bytes]:
    """(private PKCS8 PEM, public SPKI PEM)."""
    if curve not in CURVES:
        raise ValueError(f"Unsupported curve: {curve}. Supported: {', '.join(CURVES)}")
    private, public = _generate(curve)
    return _pem("PRIVATE", bytes(_spec(private, "PKCS8EncodedKeySpec").getEncoded())), _pem("PUBLIC", bytes(_spec(public, "X509EncodedKeySpec").getEncoded()))


def _generate(curve: str):
    j = _jvm()
    g = j.java.security.KeyPairGenerator.getInstance("EC")
    g.initialize(j.java.security.spec.ECGenParameterSpec(CURVES[curve]))
    pair = g.generateKeyPair()
    return pair.getPrivate(), pair.getPublic()


def public_of(private_pem: bytes, candidates: list[bytes | str]) -> bytes | None:
    """Which of the public keys belongs to the private key: both agree with a fresh pair on the same secret."""
    private = _private(private_pem)
    for c in candidates:
        public = _public(c)
        if _curve_of(public) == _curve_of(private):
            one, other = _generate(_curve_of(private))
            if _agree(private, other) == _agree(one, public):
                return c.encode() if isinstance(c, str) else c
    return None


def fingerprint(public_pem: bytes | str) -> str:
    digest = hashlib.sha256(_der(public_pem)).hexdigest().upper()
    return ":".join(digest[i : i + 2] for i in range(0, len(digest), 2))


def kid_of(print_: str) -> str:
    if not print_.strip():
        raise ValueError("Fingerprint must not be empty.")
    return f"sha256:{print_.strip().lower().replace(':', '-')}"


def _agree(private, public) -> bytes:
    a = _jvm().javax.crypto.KeyAgreement.getInstance("ECDH")
    a.init(private)
    a.doPhase(public, True)
    return bytes(a.generateSecret())


def _concat_kdf(z: bytes, algorithm: str) -> bytes:
    """256 bits after RFC 7518, without party information."""
    name = algorithm.encode()
    other = struct.pack(">I", len(name)) + name + struct.pack(">II", 0, 0) + struct.pack(">I", 256)
    return hashlib.sha256(struct.pack(">I", 1) + z + other).digest()


def hkdf(secret: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    key, out, block, n = hmac.new(salt, secret, hashlib.sha256).digest(), b"", b"", 1
    while len(out) < length:
        block = hmac.new(key, block + info + bytes([n]), hashlib.sha256).digest()
        out, n = out + block, n + 1
    return out[:length]


def _aes_key(raw: bytes):
    return _jvm().javax.crypto.spec.SecretKeySpec(bytearray(raw), "AES")


def _wrap(kek: bytes, key: bytes) -> bytes:
    c = _jvm().javax.crypto.Cipher.getInstance("AESWrap")
    c.init(3, _aes_key(kek))  # wrap mode
    return bytes(c.wrap(_aes_key(key)))


def _unwrap(kek: bytes, wrapped: bytes) -> bytes:
    c = _jvm().javax.crypto.Cipher.getInstance("AESWrap")
    c.init(4, _aes_key(kek))  # unwrap mode
    return bytes(c.unwrap(bytearray(wrapped), "AES", 3).getEncoded())


def _gcm(mode: int, key: bytes, iv: bytes, aad: bytes, data: bytes) -> bytes:
    j = _jvm()
    c = j.javax.crypto.Cipher.getInstance("AES/GCM/NoPadding")
    c.init(mode, _aes_key(key), j.javax.crypto.spec.GCMParameterSpec(128, bytearray(iv)))
    c.updateAAD(bytearray(aad))
    return bytes(c.doFinal(bytearray(data)))


ALGORITHM = "ECDH-ES+A256KW"


def _recipient(public_pem: bytes, content_key: bytes) -> dict:
    public = _public(public_pem)
    curve = _curve_of(public)
    one, shown = _generate(curve)
    size = (_field_size(public) + 7) // 8
    point = _spec(shown, "ECPublicKeySpec").getW()
    number = lambda n: _b64(int(n.toString()).to_bytes(size, "big"))
    epk = {"kty": "EC", "crv": curve, "x": number(point.getAffineX()), "y": number(point.getAffineY())}
    header = {"alg": ALGORITHM, "kid": kid_of(fingerprint(public_pem)), "epk": epk}
    return {"header": header, "encrypted_key": _b64(_wrap(_concat_kdf(_agree(one, public), ALGORITHM), content_key))}


def build(name: str, sender_public: bytes, recipient_public: bytes, secret: bytes | None = None, exchange_id: str | None = None, kind: str = TYPE, content: str = CONTENT) -> dict:
    """An exchange document for both sides. Without a secret, 32 random bytes are taken."""
    payload = {
        "exchangeName": name, "hashingSecret": _b64(secret or secrets.token_bytes(32)), "hashingSecretEncoding": "base64url",
        "senderKeyFingerprint": fingerprint(sender_public), "recipientKeyFingerprint": fingerprint(recipient_public),
        "senderPublicKey": sender_public.decode(), "recipientPublicKey": recipient_public.decode(), "curve": _curve_of(_public(sender_public)),
        "createdAt": datetime.now(timezone.utc).isoformat(), "exchangeId": exchange_id or str(uuid.uuid4()),
    }
    protected = _b64(json.dumps({"typ": kind, "cty": content, "enc": "A256GCM"}, separators=(",", ":")).encode())
    key, iv = secrets.token_bytes(32), secrets.token_bytes(12)
    sealed = _gcm(1, key, iv, protected.encode(), json.dumps(payload, separators=(",", ":")).encode())
    return {"version": 1, "protected": protected, "recipients": [_recipient(p, key) for p in (sender_public, recipient_public)], "iv": _b64(iv), "ciphertext": _b64(sealed[:-16]), "tag": _b64(sealed[-16:])}


def _open(document: Mapping, private_pem: bytes) -> bytes:
    j = _jvm()
    private = _private(private_pem)
    curve = _curve_of(private)
    for r in document["recipients"]:
        epk = r["header"]["epk"]
        if epk["crv"] != curve:
            continue
        big = lambda t: j.java.math.BigInteger(1, bytearray(_unb64(t)))
        point = j.java.security.spec.ECPoint(big(epk["x"]), big(epk["y"]))
        shown = j.java.security.KeyFactory.getInstance("EC").generatePublic(j.java.security.spec.ECPublicKeySpec(point, _curve_params(curve)))
        try:
            key = _unwrap(_concat_kdf(_agree(private, shown), ALGORITHM), _unb64(r["encrypted_key"]))
        except Exception:  # noqa: BLE001  the other recipient's entry does not unwrap
            continue
        return _gcm(2, key, _unb64(document["iv"]), document["protected"].encode(), _unb64(document["ciphertext"]) + _unb64(document["tag"]))
    raise ValueError("no recipient entry opens with this private key")


@dataclass(frozen=True)
class Exchange:
    document: Mapping
    payload: Mapping
    private_pem: bytes
    role: str
    hashing_secret: bytes


def default_path() -> Path:
    return Path(f"./hushjoin-{date.today().isoformat()}.exchange.json")


def load(path: str | Path | None = None, value: str | bytes | Mapping | None = None) -> Mapping:
    """The document from a path or a value, not both; only supported versions."""
    if path and value is not None:
        raise ValueError("give a path or a value of the exchange settings, not both")
    if value is None:
        path = Path(path) if path else default_path()
        if not path.exists():
            raise FileNotFoundError(f"exchange settings not found: {path}")
        value = path.read_bytes()
    try:
        document = dict(value) if isinstance(value, Mapping) else json.loads(value)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ValueError(f"the exchange settings are not valid JSON: {e}") from e
    if not isinstance(document, dict):
        raise ValueError("the exchange settings must be a JSON object")
    if document.get("version") not in VERSIONS:
        raise ValueError(f"unsupported version of exchange settings: {document.get('version')}. Supported: {sorted(VERSIONS)}")
    return document


def find_private_key(document: Mapping, path=None, env: str | None = None, value=None, folder: str | Path = KEY_FOLDER, environment: Mapping | None = None) -> bytes:
    """The private key from one of path, environment variable and value, else from the key folder by recipient kid."""
    if sum(x is not None for x in (path, env, value)) > 1:
        raise ValueError("give only one of private key path, environment variable and value")
    if path is not None:
        if not Path(path).is_file():
            raise FileNotFoundError(f"private key not found: {path}")
        return Path(path).read_bytes()
    if env is not None:
        value = (os.environ if environment is None else environment).get(env) or ""
    if value is not None:
        raw = value.encode() if isinstance(value, str) else value
        if not raw.strip():
            raise ValueError("the private key is empty")
        return raw
    kids = [r["header"]["kid"] for r in document.get("recipients") or [] if isinstance(r, dict) and (r.get("header") or {}).get("kid")]
    if not kids:
        raise ValueError("the exchange settings name no recipient keys")
    for public in sorted(Path(folder).expanduser().glob("*.public.pem")):
        private = public.with_name(public.name.removesuffix(".public.pem") + ".private.pem")
        if kid_of(fingerprint(public.read_bytes())) in kids and private.exists():
            return private.read_bytes()
    raise FileNotFoundError(f"no private key for these exchange settings in {folder}")


def resolve(path=None, value=None, private_key_path=None, private_key_env=None, private_key_value=None, folder: str | Path = KEY_FOLDER) -> Exchange:
    document = load(path, value)
    pem = find_private_key(document, private_key_path, private_key_env, private_key_value, folder)
    try:
        payload = json.loads(_open(document, pem))
    except Exception as e:
        raise ValueError(f"the exchange settings cannot be decrypted: {e}") from e
    if payload.get("hashingSecretEncoding") != "base64url" or not payload.get("hashingSecret"):
        raise ValueError("the exchange settings hold no hashing secret in base64url")
    keys = {"sender": payload.get("senderPublicKey"), "recipient": payload.get("recipientPublicKey")}
    own = public_of(pem, [k for k in keys.values() if k])
    role = next((r for r, k in keys.items() if own and k and fingerprint(k) == fingerprint(own) == payload.get(f"{r}KeyFingerprint")), None)
    if role is None:
        raise ValueError("the private key is neither the sender's nor the recipient's")
    return Exchange(document, payload, pem, role, _unb64(payload["hashingSecret"]))


def transport_key(exchange: Exchange, info: bytes = INFO) -> bytes:
    """The 32-byte key that both sides derive."""
    other = exchange.payload.get("recipientPublicKey" if exchange.role == "sender" else "senderPublicKey")
    if not other or not exchange.payload.get("exchangeId"):
        raise ValueError("the exchange settings lack a public key or the exchange id")
    return hkdf(_agree(_private(exchange.private_pem), _public(other)), exchange.payload["exchangeId"].encode(), info)


def save_key_pair(folder: str | Path, name: str, private_pem: bytes, public_pem: bytes, overwrite: bool = False) -> tuple[Path, Path]:
    """Write <name>.private.pem (owner only) and <name>.public.pem. Links are not followed."""
    folder = Path(folder).expanduser()
    folder.mkdir(parents=True, exist_ok=True)
    os.chmod(folder, stat.S_IRWXU)
    out = []
    for kind, raw, mode in (("private", private_pem, 0o600), ("public", public_pem, 0o644)):
        path = folder / f"{name}.{kind}.pem"
        if path.is_symlink():
            raise OSError(f"{path} must not be a symbolic link")
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | (os.O_TRUNC if overwrite else os.O_EXCL) | os.O_NOFOLLOW, mode)
        with os.fdopen(fd, "wb") as f:
            f.write(raw)
        out.append(path)
    return out[0], out[1]
