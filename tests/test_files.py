import struct
import zlib

import numpy as np
import pytest

from tidewire.sources.files import load_json, read_matlab, save_json


def element(end, kind, content):
    return struct.pack(f"{end}II", kind, len(content)) + content + bytes(-len(content) % 8)


def matrix(end, name, values, stored):
    """A double matrix of version 5, its values stored as a smaller kind."""
    kinds = {"f8": 9, "u1": 2, "i2": 3}
    dims = struct.pack(f"{end}{values.ndim}i", *values.shape)
    short = struct.pack(f"{end}I", len(name) << 16 | 1) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(end, 1, name.encode())
    body = element(end, 6, struct.pack(f"{end}II", 6, 0)) + element(end, 5, dims) + short + element(end, kinds[stored], values.astype(end + stored).tobytes(order="F"))
    return element(end, 14, body)


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_matlab_version_5(tmp_path, end, packed):
    a, b = np.arange(24.0).reshape(2, 3, 4), np.array([[1.5, -2.0]])
    body = matrix(end, "long_name", a, "u1") + matrix(end, "b", b, "f8")
    if packed:
        body = b"".join(struct.pack(f"{end}II", 15, len(z)) + z for z in (zlib.compress(matrix(end, "long_name", a, "u1")), zlib.compress(matrix(end, "b", b, "f8"))))
    path = tmp_path / "x.mat"
    path.write_bytes(b"MATLAB 5.0".ljust(124) + struct.pack(f"{end}HH", 0x0100, 0x4D49) + body)
    assert np.array_equal(read_matlab(path, "long_name"), a) and np.array_equal(read_matlab(path, "b"), b)
    with pytest.raises(KeyError):
        read_matlab(path, "c")


def test_matlab_version_4(tmp_path):
    a, b = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]), np.array([[7, 8]])
    path = tmp_path / "x.mat"
    path.write_bytes(struct.pack("<5I", 0, 3, 2, 0, 2) + b"a\0" + a.tobytes(order="F") + struct.pack("<5I", 30, 1, 2, 0, 3) + b"bb\0" + b.astype("<i2").tobytes())
    assert np.array_equal(read_matlab(path, "a"), a) and np.array_equal(read_matlab(path, "bb"), b)


def test_json_round_trip(tmp_path):
    path = tmp_path / "x.json"
    save_json({"a": np.arange(3), "b": np.float64(0.5), "c": "x"}, path)
    assert load_json(path) == {"a": [0, 1, 2], "b": 0.5, "c": "x"}
