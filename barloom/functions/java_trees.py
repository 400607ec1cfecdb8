"""The tree learners of :mod:`barloom.functions.histogram_trees` in Java, for Spark's own processes.

The session compiles the source with the compiler Spark brings for its generated code and sends the classes to
the executors as a jar. Fits draw the same rows and columns as numpy's legacy generator does for their seed, and
cut where the Python learners cut.
"""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.types import _parse_datatype_string

from barloom.functions.histogram_trees import BOOSTED_BINS, LEAST_GAIN, MAX_BINS, TIE
from barloom.functions.shared_boosting import DEFAULTS
from barloom.schemas import NOT_FINITE

#: Order of a fit's parameters in the array that the functions take.
PARAMS = [
    "forest", "seed", "checked", "n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree", "min_child_weight", "reg_alpha", "reg_lambda"
]

#: Functions by class: their name in SQL and what they return.
FUNCTIONS = {
    "Forecasts": ("barloom_forecasts", "array<struct<day:int,actual:double,prediction:double,error:string>>"),
    "Errors": ("barloom_errors", "array<double>"),
}

_READY: set[tuple] = set()

SOURCE = """
package barloom.trees;

public final class Trees {
  static final double LEAST_GAIN = %(gain)r, TIE = %(tie)r;

  /** numpy.random.RandomState of a whole-numbered seed. */
  static final class Draw {
    private final int[] state = new int[624];
    private int at = 624;

    Draw(long seed) {
      state[0] = (int) seed;
      for (int i = 1; i < 624; i++) state[i] = 1812433253 * (state[i - 1] ^ (state[i - 1] >>> 30)) + i;
    }

    private int next() {
      if (at == 624) {
        for (int i = 0; i < 624; i++) {
          int y = (state[i] & 0x80000000) | (state[(i + 1) %% 624] & 0x7fffffff);
          state[i] = state[(i + 397) %% 624] ^ (y >>> 1) ^ ((y & 1) != 0 ? 0x9908b0df : 0);
        }
        at = 0;
      }
      int y = state[at++];
      y ^= y >>> 11;
      y ^= (y << 7) & 0x9d2c5680;
      y ^= (y << 15) & 0xefc60000;
      return y ^ (y >>> 18);
    }

    /** A number from 0 to max. */
    int upTo(int max) {
      if (max == 0) return 0;
      int mask = -1 >>> Integer.numberOfLeadingZeros(max);
      int value = next() & mask;
      while (value > max) value = next() & mask;
      return value;
    }

    int[] permutation(int n) {
      int[] out = new int[n];
      for (int i = 0; i < n; i++) out[i] = i;
      for (int i = n - 1; i > 0; i--) {
        int j = upTo(i), held = out[j];
        out[j] = out[i];
        out[i] = held;
      }
      return out;
    }
  }

  /** Rows of one group, those to train on first by feature, and those to forecast. */
  static final class Group {
    final int n, m, width;
    final double[][] x, tested;
    final double[] y, actual;
    final int[] days;
    final boolean finite;
    double mean, scale;
    double[] target;
    final int[][][] codes = new int[2][][], order = new int[2][][], testCodes = new int[2][][];

    Group(scala.collection.Seq rows) {
      int size = rows.length(), train = 0, features = 0;
      org.apache.spark.sql.Row[] own = new org.apache.spark.sql.Row[size];
      scala.collection.Iterator all = rows.iterator();
      for (int i = 0; i < size; i++) {
        own[i] = (org.apache.spark.sql.Row) all.next();
        if (own[i].getBoolean(2)) train++;
      }
      if (size > 0) features = ((scala.collection.Seq) own[0].get(4)).length();
      n = train;
      m = size - train;
      width = features;
      x = new double[width][n];
      tested = new double[width][m];
      y = new double[n];
      actual = new double[m];
      days = new int[m];
      boolean sound = true;
      int a = 0, b = 0;
      for (int i = 0; i < size; i++) {
        boolean trains = own[i].getBoolean(2);
        double value = own[i].getDouble(3);
        sound &= !Double.isNaN(value) && !Double.isInfinite(value);
        scala.collection.Iterator cells = ((scala.collection.Seq) own[i].get(4)).iterator();
        for (int f = 0; f < width; f++) {
          double cell = ((Double) cells.next()).doubleValue() + 0.0;
          sound &= !Double.isNaN(cell) && !Double.isInfinite(cell);
          if (trains) x[f][a] = cell;
          else tested[f][b] = cell;
        }
        if (trains) y[a++] = value;
        else {
          actual[b] = value;
          days[b++] = own[i].getInt(1);
        }
      }
      finite = sound;
      double total = 0;
      for (int i = 0; i < n; i++) total += y[i];
      mean = total / n;
      double top = 0;
      for (int i = 0; i < n; i++) top = Math.max(top, Math.abs(y[i] - mean));
      scale = top > 0 && !Double.isInfinite(top) ? Math.pow(2.0, -(Math.getExponent(top) + 1)) : 1.0;
      target = new double[n];
      for (int i = 0; i < n; i++) target[i] = (y[i] - mean) * scale;
    }

    /** Bin numbers, and the rows in their order, for forests (0) or boosted trees (1). */
    void bin(int kind) {
      if (codes[kind] != null) return;
      int bins = kind == 0 ? %(bins)d : %(boosted)d;
      int[][] code = new int[width][n], sorted = new int[width][n], test = new int[width][m];
      for (int f = 0; f < width; f++) {
        double[] values = (double[]) x[f].clone();
        java.util.Arrays.sort(values);
        double[] distinct = distinct(values);
        if (distinct.length > bins) {
          double[] chosen = new double[bins];
          double step = 1.0 / (bins - 1);
          for (int k = 0; k < bins; k++) chosen[k] = values[(int) Math.rint((n - 1) * (k == bins - 1 ? 1.0 : k * step))];
          distinct = distinct(chosen);
        }
        double[] edges = new double[Math.max(0, distinct.length - 1)];
        for (int k = 0; k < edges.length; k++) edges[k] = (distinct[k] + distinct[k + 1]) / 2;
        int[] starts = new int[edges.length + 2];
        for (int i = 0; i < n; i++) {
          code[f][i] = place(edges, x[f][i]);
          starts[code[f][i] + 1]++;
        }
        for (int k = 1; k < starts.length; k++) starts[k] += starts[k - 1];
        for (int i = 0; i < n; i++) sorted[f][starts[code[f][i]]++] = i;
        for (int i = 0; i < m; i++) test[f][i] = place(edges, tested[f][i]);
      }
      order[kind] = sorted;
      testCodes[kind] = test;
      codes[kind] = code;
    }

    private static double[] distinct(double[] sorted) {
      double[] out = new double[sorted.length];
      int count = 0;
      for (int i = 0; i < sorted.length; i++) if (i == 0 || (sorted[i] != sorted[i - 1] && !(Double.isNaN(sorted[i]) && Double.isNaN(sorted[i - 1])))) out[count++] = sorted[i];
      return java.util.Arrays.copyOf(out, count);
    }

    /** Edges below a value. */
    private static int place(double[] edges, double value) {
      int low = 0, high = edges.length;
      while (low < high) {
        int middle = (low + high) >>> 1;
        if (edges[middle] < value) low = middle + 1;
        else high = middle;
      }
      return low;
    }
  }

  static double shrunk(double g, double l1) {
    double size = Math.abs(g) - l1;
    return size > 0 ? (g > 0 ? size : -size) : (size <= 0 ? 0.0 : size);
  }

  /** One tree: nodes with the number of their left child (the right one follows), 0 at a leaf. */
  static final class Tree {
    final int[] feature, cut, left, start, stop, level;
    final double[] value, total, scores, leftSums;
    final long[] size, leftSizes;
    final int[] cutFeatures, cutPlaces, held, stack;
    final int[][] lanes;
    int nodes;

    Tree(int n, int width) {
      int most = 2 * n + 1;
      feature = new int[most];
      cut = new int[most];
      left = new int[most];
      start = new int[most];
      stop = new int[most];
      level = new int[most];
      stack = new int[most];
      value = new double[most];
      total = new double[most];
      size = new long[most];
      scores = new double[n * width];
      leftSums = new double[n * width];
      leftSizes = new long[n * width];
      cutFeatures = new int[n * width];
      cutPlaces = new int[n * width];
      held = new int[n];
      lanes = new int[width][n];
    }

    void grow(int[][] codes, int[][] order, double[] g, int[] weight, int[] columns, int depth, double least, double l1, double l2, double gain) {
      int count = 0;
      for (int c = 0; c < columns.length; c++) {
        int[] lane = lanes[columns[c]], from = order[columns[c]];
        count = 0;
        for (int i = 0; i < from.length; i++) {
          lane[count] = from[i];
          count += weight[from[i]] > 0 ? 1 : 0;
        }
      }
      nodes = 1;
      start[0] = level[0] = left[0] = 0;
      stop[0] = count;
      total[0] = 0;
      size[0] = 0;
      for (int i = 0; i < g.length; i++) {
        total[0] += g[i];
        size[0] += weight[i];
      }
      value[0] = shrunk(total[0], l1) / (size[0] + l2);
      int waiting = 1;
      stack[0] = 0;
      while (waiting > 0) {
        int node = stack[--waiting];
        if (level[node] >= depth || size[node] < 2 * least || stop[node] - start[node] < 2) continue;
        int cuts = 0;
        double top = Double.NEGATIVE_INFINITY;
        double all = total[node];
        long whole = size[node];
        int first = start[node], end = stop[node];
        for (int c = 0; c < columns.length; c++) {
          cuts = scan(codes[columns[c]], lanes[columns[c]], g, weight, first, end, cuts, columns[c]);
        }
        int kept = 0;
        for (int k = 0; k < cuts; k++) {
          long own = leftSizes[k];
          double score = Double.NEGATIVE_INFINITY;
          if (own >= least && whole - own >= least) {
            double a = leftSums[k], b = all - a;
            if (l1 != 0) {
              a = Math.max(Math.abs(a) - l1, 0.0);
              b = Math.max(Math.abs(b) - l1, 0.0);
            }
            score = a * a / (own + l2) + b * b / (whole - own + l2);
          }
          scores[k] = score;
          if (score > top) top = score;
        }
        double parent = Math.max(Math.abs(all) - l1, 0.0);
        if (!(top - parent * parent / (whole + l2) > gain)) continue;
        double bar = top * (1 - TIE);
        int best = 0;
        while (!(scores[best] >= bar)) best++;
        int by = cutFeatures[best], last = cutPlaces[best];
        int at = codes[by][lanes[by][last]];
        feature[node] = by;
        cut[node] = at;
        left[node] = nodes;
        int middle = last + 1;
        total[nodes] = leftSums[best];
        total[nodes + 1] = all - leftSums[best];
        size[nodes] = leftSizes[best];
        size[nodes + 1] = whole - leftSizes[best];
        for (int side = 0; side < 2; side++) {
          int child = nodes + side;
          left[child] = 0;
          level[child] = level[node] + 1;
          start[child] = side == 0 ? first : middle;
          stop[child] = side == 0 ? middle : end;
          value[child] = shrunk(total[child], l1) / (size[child] + l2);
        }
        if (level[node] + 1 < depth) {
          for (int c = 0; c < columns.length; c++) if (columns[c] != by) part(codes[by], lanes[columns[c]], first, end, at);
          stack[waiting++] = nodes + 1;
          stack[waiting++] = nodes;
        }
        nodes += 2;
      }
    }

    /** Sums left of each cut between two bins of a lane. */
    private int scan(int[] code, int[] lane, double[] g, int[] weight, int first, int end, int cuts, int column) {
      double sum = 0;
      long size = 0;
      int row = lane[first], bin = code[row];
      for (int i = first + 1; i < end; i++) {
        sum += g[row];
        size += weight[row];
        row = lane[i];
        int next = code[row];
        if (next != bin) {
          leftSums[cuts] = sum;
          leftSizes[cuts] = size;
          cutFeatures[cuts] = column;
          cutPlaces[cuts++] = i - 1;
          bin = next;
        }
      }
      return cuts;
    }

    /** Rows up to a bin before the others, both in their order. */
    private void part(int[] code, int[] lane, int first, int end, int at) {
      int low = first, high = 0;
      for (int i = first; i < end; i++) {
        int row = lane[i];
        int side = (at - code[row]) >>> 31;
        lane[low] = row;
        held[high] = row;
        low += 1 - side;
        high += side;
      }
      System.arraycopy(held, 0, lane, low, high);
    }

    void add(int[][] codes, double rate, double[] out) {
      for (int i = 0; i < out.length; i++) {
        int node = 0;
        while (left[node] != 0) node = left[node] + (codes[feature[node]][i] > cut[node] ? 1 : 0);
        out[i] += rate * value[node];
      }
    }
  }

  static double[] fit(Group own, double[] p) {
    boolean forest = p[0] != 0;
    int kind = forest ? 0 : 1, rounds = (int) p[3], depth = (int) p[4], n = own.n, width = own.width;
    if (n == 0) throw new IllegalArgumentException("there are no rows to train on");
    double rate = forest ? 1.0 : p[5], l1 = p[9] * own.scale, l2 = p[10], gain = LEAST_GAIN * own.scale * own.scale, least = Math.max(p[8], 1e-9);
    own.bin(kind);
    Draw draw = new Draw((long) p[1]);
    int rows = Math.max(1, (int) Math.rint(p[6] * n)), some = Math.max(1, (int) (p[7] * width));
    int[] weight = new int[n], columns = new int[width];
    java.util.Arrays.fill(weight, 1);
    for (int f = 0; f < width; f++) columns[f] = f;
    double[] fitted = new double[n], g = new double[n], out = new double[own.m];
    Tree tree = new Tree(n, width);
    for (int round = 0; round < rounds; round++) {
      if (forest) {
        java.util.Arrays.fill(weight, 0);
        for (int i = 0; i < n; i++) weight[draw.upTo(n - 1)]++;
      } else {
        if (rows < n) {
          java.util.Arrays.fill(weight, 1);
          int[] turn = draw.permutation(n);
          for (int i = rows; i < n; i++) weight[turn[i]] = 0;
        }
        if (some < width) {
          columns = java.util.Arrays.copyOf(draw.permutation(width), some);
          java.util.Arrays.sort(columns);
        }
      }
      for (int i = 0; i < n; i++) g[i] = weight[i] * (own.target[i] - fitted[i]);
      tree.grow(own.codes[kind], own.order[kind], g, weight, columns, depth, least, l1, l2, gain);
      if (!forest) tree.add(own.codes[kind], rate, fitted);
      tree.add(own.testCodes[kind], rate, out);
    }
    double share = forest ? rounds * own.scale : own.scale;
    for (int i = 0; i < out.length; i++) out[i] = out[i] / share + own.mean;
    return out;
  }

  static double[] doubles(Object values) {
    scala.collection.Seq own = (scala.collection.Seq) values;
    double[] out = new double[own.length()];
    for (int i = 0; i < out.length; i++) out[i] = ((Double) own.apply(i)).doubleValue();
    return out;
  }
}
"""

FORECASTS = """
package barloom.trees;

/** Forecasts of a group's rows by one fit, or one row with what the fit fails with. */
public class Forecasts implements org.apache.spark.sql.api.java.UDF2 {
  public Object call(Object rows, Object params) {
    try {
      Trees.Group own = new Trees.Group((scala.collection.Seq) rows);
      double[] p = Trees.doubles(params);
      if (p[2] != 0 && !own.finite) return failed(%(message)s);
      double[] found = Trees.fit(own, p);
      Object[] out = new Object[own.m];
      for (int i = 0; i < own.m; i++) {
        out[i] = org.apache.spark.sql.RowFactory.create(
            new Object[] {Integer.valueOf(own.days[i]), Double.valueOf(own.actual[i]), Double.valueOf(found[i]), null});
      }
      return out;
    } catch (RuntimeException error) {
      return failed(error.getClass().getSimpleName() + ": " + error.getMessage());
    }
  }

  private static Object failed(String message) {
    return new Object[] {org.apache.spark.sql.RowFactory.create(new Object[] {null, null, null, message})};
  }
}
"""

ERRORS = """
package barloom.trees;

/** Mean squared error of a group's rows for each of many fits. */
public class Errors implements org.apache.spark.sql.api.java.UDF2 {
  public Object call(Object rows, Object candidates) {
    Trees.Group own = new Trees.Group((scala.collection.Seq) rows);
    scala.collection.Seq all = (scala.collection.Seq) candidates;
    Object[] out = new Object[all.length()];
    for (int c = 0; c < out.length; c++) {
      double[] found = Trees.fit(own, Trees.doubles(all.apply(c)));
      double total = 0;
      for (int i = 0; i < own.m; i++) total += (found[i] - own.actual[i]) * (found[i] - own.actual[i]);
      out[c] = Double.valueOf(total / own.m);
    }
    return out;
  }
}
"""


def params_of(learner: str, params: dict, seed: int, checked: bool = False) -> list[float]:
    """A fit's parameters as the functions take them; a ``checked`` fit fails on numbers that are not finite."""
    given = dict(params)
    if learner == "forest":
        given["min_child_weight"] = given.pop("min_samples_leaf", 1)
        own = DEFAULTS | {"reg_lambda": 0.0, "learning_rate": 1.0} | given
    else:
        own = DEFAULTS | given
    own |= {"forest": learner == "forest", "seed": seed, "checked": checked}
    unknown = set(own) - set(PARAMS)
    if unknown:
        raise TypeError(f"a {learner} fit has no parameter {', '.join(sorted(unknown))}")
    return [float(own[name]) for name in PARAMS]


def available(spark: SparkSession) -> bool:
    """Whether the functions can be called in this session; registers them on first use."""
    try:
        jvm = spark._jvm
        key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode())
    except Exception:  # noqa: BLE001  (a session without a JVM of its own, by whatever error it says so)
        return False
    if key not in _READY:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        numbers = {"gain": LEAST_GAIN, "tie": TIE, "bins": MAX_BINS, "boosted": BOOSTED_BINS}
        quoted = '"' + NOT_FINITE.replace('"', '\\"') + '"'
        parts = [SOURCE % numbers, FORECASTS % {"message": quoted}, ERRORS]
        package, *bodies = "\n".join(parts).split("package barloom.trees;")
        compiler.cook("package barloom.trees;" + "\n".join(bodies))
        folder = tempfile.mkdtemp(prefix="barloom-jar-")
        jar = os.path.join(folder, "trees.jar")
        compiled = compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w") as file:
            for name in compiled.keySet():
                file.writestr(name.replace(".", "/") + ".class", bytes(compiled.get(name)))
        spark.sparkContext._jsc.addJar(jar)
        for name, (function, returns) in FUNCTIONS.items():
            instance = compiler.getClassLoader().loadClass(f"barloom.trees.{name}").newInstance()
            kind = spark._jsparkSession.parseDataType(_parse_datatype_string(returns).json())
            spark._jsparkSession.udf().register(function, instance, kind)
        _READY.add(key)
    return True
