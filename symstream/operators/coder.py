"""The adaptive coder of ``adaptive`` inside the executors' JVM: the same model and the same bytes, a text or code at a time.

A symbol depends on all that were decoded before it, so there is nothing to be done by columns. The source below is compiled by the compiler
that Spark brings for its own generated code, and added to the session as a jar; executors fetch it as they do any other.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SOURCE = """
package symstream;

public class Ppm implements java.io.Serializable {
    static final int SENTINEL = 256;
    final int order, step;
    // followers of contexts in the order of their first occurrence, and contexts
    int[] sym = new int[1024], count = new int[1024], next = new int[1024], child = new int[1024];
    int[] head = new int[512], tail = new int[512], types = new int[512];
    int entries = 1, nodes = 1, known = 0;
    int[] context, found;
    int[] gone = new int[257];
    int turn = 0, left = 0;
    // coder
    long low = 0L, high = (1L << 32) - 1L, value = 0L;
    long pending = 0L;
    byte[] data = new byte[256];
    long at = 0L, size = 0L;

    Ppm(int order, int step) {
        this.order = order;
        this.step = step;
        context = new int[Math.max(order, 0) + 2];
        found = new int[Math.max(order, 0) + 2];
        known = order < 0 ? -1 : 0; // the longest context
    }

    int node() {
        if (nodes == head.length) {
            head = java.util.Arrays.copyOf(head, 2 * nodes);
            tail = java.util.Arrays.copyOf(tail, 2 * nodes);
            types = java.util.Arrays.copyOf(types, 2 * nodes);
        }
        return nodes++;
    }

    int mass(int n) {
        int mass = 0;
        for (int e = head[n]; e != 0; e = next[e]) {
            if (gone[sym[e]] != turn) {
                mass += count[e];
            }
        }
        return mass;
    }

    void exclude(int n) {
        for (int e = head[n]; e != 0; e = next[e]) {
            if (gone[sym[e]] != turn) {
                gone[sym[e]] = turn;
                if (sym[e] != SENTINEL) {
                    left--;
                }
            }
        }
    }

    void encode(int symbol) {
        turn++;
        left = 256;
        for (int k = known; k >= 0; k--) {
            int n = context[k];
            if (types[n] == 0) {
                continue;
            }
            int mass = 0, own = 0, before = 0;
            for (int e = head[n]; e != 0; e = next[e]) {
                if (gone[sym[e]] != turn) {
                    if (sym[e] == symbol) {
                        own = count[e];
                        before = mass;
                    }
                    mass += count[e];
                }
            }
            if (mass == 0) {
                continue;
            }
            int total = mass + types[n];
            if (own > 0) {
                code(before, before + own, total);
                return;
            }
            code(mass, total, total);
            exclude(n);
        }
        int place = left;
        if (symbol != SENTINEL) {
            place = symbol;
            for (int s = 0; s < symbol; s++) {
                if (gone[s] == turn) {
                    place--;
                }
            }
        }
        code(place, place + 1, left + 1);
    }

    int decode() {
        turn++;
        left = 256;
        for (int k = known; k >= 0; k--) {
            int n = context[k];
            if (types[n] == 0) {
                continue;
            }
            int mass = mass(n);
            if (mass == 0) {
                continue;
            }
            int total = mass + types[n];
            long target = target(total);
            if (target < mass) {
                int before = 0;
                for (int e = head[n]; e != 0; e = next[e]) {
                    if (gone[sym[e]] != turn) {
                        if (target < before + count[e]) {
                            take(before, before + count[e], total);
                            return sym[e];
                        }
                        before += count[e];
                    }
                }
            }
            take(mass, total, total);
            exclude(n);
        }
        int place = (int) target(left + 1);
        take(place, place + 1, left + 1);
        if (place == left) {
            return SENTINEL;
        }
        for (int s = 0; s < 256; s++) {
            if (gone[s] != turn && place-- == 0) {
                return s;
            }
        }
        throw new IllegalStateException("no symbol");
    }

    void update(int symbol) {
        boolean longer = false;
        for (int k = known; k >= 0; k--) {
            int n = context[k];
            int e = head[n];
            while (e != 0 && sym[e] != symbol) {
                e = next[e];
            }
            if (e != 0) {
                if (!longer) {
                    count[e] += step;
                }
                longer = true;
            } else {
                if (entries == sym.length) {
                    sym = java.util.Arrays.copyOf(sym, 2 * entries);
                    count = java.util.Arrays.copyOf(count, 2 * entries);
                    next = java.util.Arrays.copyOf(next, 2 * entries);
                    child = java.util.Arrays.copyOf(child, 2 * entries);
                }
                e = entries++;
                sym[e] = symbol;
                count[e] = 1;
                if (head[n] == 0) {
                    head[n] = e;
                } else {
                    next[tail[n]] = e;
                }
                tail[n] = e;
                types[n]++;
            }
            found[k] = e;
        }
        if (order < 1) {
            return;
        }
        known = Math.min(order, known + 1);
        for (int k = known; k > 0; k--) { // the context that is one symbol longer
            int e = found[k - 1];
            if (child[e] == 0) {
                child[e] = node();
            }
            context[k] = child[e];
        }
    }

    void code(long from, long to, long total) {
        long span = high - low + 1L;
        high = low + span * to / total - 1L;
        low = low + span * from / total;
        while (true) {
            if (high < 1L << 31) {
                bits(0);
            } else if (low >= 1L << 31) {
                bits(1);
                low -= 1L << 31;
                high -= 1L << 31;
            } else if (low >= 1L << 30 && high < 3L << 30) {
                pending++;
                low -= 1L << 30;
                high -= 1L << 30;
            } else {
                return;
            }
            low = low * 2L;
            high = high * 2L + 1L;
        }
    }

    void bits(int bit) {
        bit(bit);
        for (; pending > 0L; pending--) {
            bit(1 - bit);
        }
    }

    void bit(int bit) {
        int place = (int) (size >> 3);
        if (place == data.length) {
            data = java.util.Arrays.copyOf(data, 2 * place);
        }
        if (bit != 0) {
            data[place] |= (byte) (128 >> (int) (size & 7L));
        }
        size++;
    }

    long target(long total) {
        return ((value - low + 1L) * total - 1L) / (high - low + 1L);
    }

    int read() {
        int place = (int) (at >> 3);
        int bit = place < data.length ? (data[place] >> (7 - (int) (at & 7L))) & 1 : 0;
        at++;
        return bit;
    }

    void take(long from, long to, long total) {
        long span = high - low + 1L;
        high = low + span * to / total - 1L;
        low = low + span * from / total;
        while (true) {
            long drop;
            if (high < 1L << 31) {
                drop = 0L;
            } else if (low >= 1L << 31) {
                drop = 1L << 31;
            } else if (low >= 1L << 30 && high < 3L << 30) {
                drop = 1L << 30;
            } else {
                return;
            }
            low = (low - drop) * 2L;
            high = (high - drop) * 2L + 1L;
            value = (value - drop) * 2L + read();
        }
    }

    public static byte[] compress(byte[] text, int order, int step) {
        Ppm p = new Ppm(order, step);
        for (int i = 0; i < text.length; i++) {
            int symbol = text[i] & 255;
            p.encode(symbol);
            p.update(symbol);
        }
        p.encode(SENTINEL);
        p.pending++;
        p.bits(p.low >= 1L << 30 ? 1 : 0);
        return java.util.Arrays.copyOf(p.data, (int) ((p.size + 7L) >> 3));
    }

    public static byte[] decompress(byte[] coded, int order, int step) {
        Ppm p = new Ppm(order, step);
        p.data = coded;
        for (int i = 0; i < 32; i++) {
            p.value = p.value * 2L + p.read();
        }
        byte[] out = new byte[256];
        int n = 0;
        while (true) {
            int symbol = p.decode();
            if (symbol == SENTINEL) {
                return java.util.Arrays.copyOf(out, n);
            }
            if (n == out.length) {
                out = java.util.Arrays.copyOf(out, 2 * n);
            }
            out[n++] = (byte) symbol;
            p.update(symbol);
        }
    }
}

public class PpmCompress implements org.apache.spark.sql.api.java.UDF3 {
    public Object call(Object data, Object order, Object step) {
        return data == null ? null : Ppm.compress((byte[]) data, ((Integer) order).intValue(), ((Integer) step).intValue());
    }
}

public class PpmDecompress implements org.apache.spark.sql.api.java.UDF3 {
    public Object call(Object data, Object order, Object step) {
        return data == null ? null : Ppm.decompress((byte[]) data, ((Integer) order).intValue(), ((Integer) step).intValue());
    }
}
"""

NAMES = {"symstream_compress": "symstream.PpmCompress", "symstream_decompress": "symstream.PpmDecompress"}


def _ready(spark: SparkSession) -> None:
    """Compiles the source and names its functions, once in a session."""
    if all(spark.catalog.functionExists(name) for name in NAMES):
        return
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(SOURCE)
    folder = tempfile.mkdtemp(prefix="symstream-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    jar = os.path.join(folder, f"symstream-{os.path.basename(folder)}.jar")
    with zipfile.ZipFile(jar, "w") as out:
        for name, code in compiler.getBytecodes().items():
            out.writestr(name.replace(".", "/") + ".class", bytes(code))
    spark.sql(f"ADD JAR '{jar}'")
    binary = spark._jvm.org.apache.spark.sql.types.DataType.fromDDL("binary")
    for name, made in NAMES.items():
        spark._jsparkSession.udf().register(name, compiler.getClassLoader().loadClass(made).newInstance(), binary)


def _call(spark: SparkSession, name: str, data: Column, order: int, method: str) -> Column:
    if method not in ("C", "D") or order < -1:
        raise ValueError("method is C or D, order -1 or more")
    _ready(spark)
    return F.call_function(name, data, F.lit(order), F.lit(2 if method == "D" else 1))


def compressed(spark: SparkSession, data: Column, order: int, method: str) -> Column:
    """``adaptive.compress`` of a binary column; null stays null."""
    return _call(spark, "symstream_compress", data, order, method)


def decompressed(spark: SparkSession, coded: Column, order: int, method: str) -> Column:
    """``adaptive.decompress`` of a binary column; null stays null."""
    return _call(spark, "symstream_decompress", coded, order, method)
