"""The row-by-row steps of forests as one small Java class, run by Spark inside its own tasks.

Growing a tree to its end follows single rows through single nodes.  As numpy
calls over a level at a time that is bound by sorting and by arrays that are
written and read again for each step; compiled loops over presorted rows take
a fraction of it.  The class is compiled at run time by Janino, the compiler
that Spark itself uses for its generated code, and shipped as a jar, so no
Java compiler is needed anywhere.

Its rules are those of :mod:`cindergrid.models.trees`, whose :func:`grow_part`
grows the same subtree in numpy (the tests compare them).
"""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

CLASS = "cindergrid.TreeSteps"

SOURCE = r"""
package cindergrid;

import java.io.Serializable;
import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.ArrayDeque;
import java.util.ArrayList;
import java.util.Arrays;
import java.util.Iterator;
import java.util.NoSuchElementException;
import org.apache.spark.api.java.function.MapPartitionsFunction;
import org.apache.spark.broadcast.Broadcast;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;

public class TreeSteps implements MapPartitionsFunction, Serializable {
  private final String step;
  private final Broadcast shared;

  public TreeSteps(String step, Broadcast shared) {
    this.step = step;
    this.shared = shared;
  }

  public Iterator call(Iterator rows) {
    State state = new State((byte[]) shared.value());
    if (step.equals("level")) return new Level(state, rows);
    if (step.equals("deal")) return new Deal(state, rows);
    if (step.equals("grow")) return new Grow(state, rows);
    if (step.equals("bundle")) return new Bundle(state, rows);
    if (step.equals("route")) return new Route(state, rows);
    if (step.equals("meet")) return new Meet(state, rows);
    throw new IllegalArgumentException(step);
  }

  static ByteBuffer little(byte[] body) {
    return ByteBuffer.wrap(body).order(ByteOrder.LITTLE_ENDIAN);
  }

  static long[] longs(ByteBuffer in, int n) {
    long[] out = new long[n];
    in.asLongBuffer().get(out);
    in.position(in.position() + 8 * n);
    return out;
  }

  static int[] ints(ByteBuffer in, int n) {
    int[] out = new int[n];
    in.asIntBuffer().get(out);
    in.position(in.position() + 4 * n);
    return out;
  }

  static double[] doubles(ByteBuffer in, int n) {
    double[] out = new double[n];
    in.asDoubleBuffer().get(out);
    in.position(in.position() + 8 * n);
    return out;
  }

  /** Arrays in the order they were put in, each behind its length. */
  static class State {
    final ByteBuffer in;

    State(byte[] body) {
      in = little(body);
    }

    int[] ints() {
      return TreeSteps.ints(in, in.getInt());
    }

    long[] longs() {
      return TreeSteps.longs(in, in.getInt());
    }

    double[] doubles() {
      return TreeSteps.doubles(in, in.getInt());
    }

    int one() {
      return ints()[0];
    }
  }

  /** Rows: ids, labels and weights where there are such, and values row by row. */
  static class Block {
    final int n;
    final long[] id;
    double[] y, w;
    final double[] x;

    Block(Row row, int f, boolean labelled) {
      n = row.getInt(0);
      ByteBuffer in = little((byte[]) row.get(1));
      id = TreeSteps.longs(in, n);
      if (labelled) {
        y = TreeSteps.doubles(in, n);
        w = TreeSteps.doubles(in, n);
      }
      x = TreeSteps.doubles(in, n * f);
    }
  }

  /** Nodes above the parts. */
  static class Nodes {
    final int[] feature, left, right;
    final double[] threshold;

    Nodes(State s) {
      feature = s.ints();
      threshold = s.doubles();
      left = s.ints();
      right = s.ints();
    }

    /** The node without children, or the negative number below, that the row with values from x[at] reaches. */
    int end(double[] x, int at, int root) {
      int node = root;
      while (node >= 0) {
        int j = feature[node];
        if (j < 0) return node;
        node = x[at + j] <= threshold[node] ? left[node] : right[node];
      }
      return node;
    }
  }

  /** The trees of a step: roots and how often they draw a row. */
  static class Draws {
    static final long PRIME = 2147483647L;
    final int[] tree, root;
    final long[] factor, addend, poisson;

    Draws(State s) {
      tree = s.ints();
      root = s.ints();
      factor = s.longs();
      addend = s.longs();
      poisson = s.longs();
    }

    int times(long id, int t) {
      if (poisson.length == 0) return 1;
      long u = id * factor[t] + addend[t];
      u = (u & PRIME) + (u >>> 31);
      u = (u & PRIME) + (u >>> 31);
      if (u == PRIME) u = 0;
      int k = 0;
      while (k < poisson.length && poisson[k] <= u) k++;
      return k;
    }
  }

  /** Histograms of the wanted nodes over all rows of the task: rows, weights and targets by feature and bin. */
  static class Level implements Iterator {
    final double[][] sums;
    final double[] squares;
    int next = 0;

    Level(State s, Iterator rows) {
      int f = s.one();
      Nodes top = new Nodes(s);
      int[] slotOf = s.ints();
      Draws draws = new Draws(s);
      int[] from = s.ints();
      double[] edges = s.doubles();
      int slots = s.one(), width = 3 * (edges.length + f);
      sums = new double[slots][];
      squares = new double[slots];
      while (rows.hasNext()) {
        Block b = new Block((Row) rows.next(), f, true);
        int[] cell = new int[b.n * f];
        for (int i = 0, at = 0; i < b.n; i++) {
          for (int j = 0; j < f; j++, at++) {
            // the first edge that isn't below the value
            int low = from[j], high = from[j + 1];
            while (low < high) {
              int mid = (low + high) >>> 1;
              if (edges[mid] < b.x[at]) low = mid + 1; else high = mid;
            }
            cell[at] = 3 * (low + j);
          }
        }
        for (int t = 0; t < draws.tree.length; t++) {
          for (int i = 0; i < b.n; i++) {
            int k = draws.times(b.id[i], t);
            if (k == 0) continue;
            int slot = slotOf[top.end(b.x, i * f, draws.root[t])];
            if (slot < 0) continue;
            double[] h = sums[slot];
            if (h == null) sums[slot] = h = new double[width];
            double w = b.w[i] * k, wy = w * b.y[i];
            squares[slot] += wy * b.y[i];
            for (int at = i * f, stop = at + f; at < stop; at++) {
              int c = cell[at];
              h[c] += 1;
              h[c + 1] += w;
              h[c + 2] += wy;
            }
          }
        }
      }
    }

    public boolean hasNext() {
      while (next < sums.length && sums[next] == null) next++;
      return next < sums.length;
    }

    public Object next() {
      if (!hasNext()) throw new NoSuchElementException();
      byte[] body = new byte[8 * (sums[next].length + 1)];
      ByteBuffer out = little(body);
      out.asDoubleBuffer().put(sums[next]);
      out.putDouble(8 * sums[next].length, squares[next]);
      sums[next] = null;
      return RowFactory.create(new Object[] {Integer.valueOf(next++), body});
    }

    public void remove() {
      throw new UnsupportedOperationException();
    }
  }

  /** An iterator whose rows come in lots. */
  abstract static class Lots implements Iterator {
    final ArrayDeque ready = new ArrayDeque();

    /** Makes the next rows ready; false where there are no more. */
    abstract boolean more();

    public boolean hasNext() {
      while (ready.isEmpty()) {
        if (!more()) return false;
      }
      return true;
    }

    public Object next() {
      if (!hasNext()) throw new NoSuchElementException();
      return ready.poll();
    }

    public void remove() {
      throw new UnsupportedOperationException();
    }
  }

  /** The rows of each part that a block has, by feature, with label and weight times draws. */
  static class Deal extends Lots {
    final Iterator rows;
    final int f;
    final Nodes top;
    final int[] isPart;
    final Draws draws;
    final int[] count, seen;
    int[] at, times;
    Block b = null;
    int t = 0;

    Deal(State s, Iterator rows) {
      this.rows = rows;
      f = s.one();
      top = new Nodes(s);
      isPart = s.ints();
      draws = new Draws(s);
      count = new int[isPart.length];
      seen = new int[isPart.length];
    }

    boolean more() {
      if (b == null || t == draws.tree.length) {
        if (!rows.hasNext()) return false;
        b = new Block((Row) rows.next(), f, true);
        at = new int[b.n];
        times = new int[b.n];
        t = 0;
      }
      int nodes = 0;
      for (int i = 0; i < b.n; i++) {
        times[i] = draws.times(b.id[i], t);
        if (times[i] == 0) continue;
        int node = top.end(b.x, i * f, draws.root[t]);
        if (isPart[node] == 0) {
          times[i] = 0;
          continue;
        }
        at[i] = node;
        if (count[node]++ == 0) seen[nodes++] = node;
      }
      double[][] made = new double[nodes][];
      int[] n = new int[nodes], filled = new int[nodes];
      for (int k = 0; k < nodes; k++) {
        n[k] = count[seen[k]];
        made[k] = new double[n[k] * (f + 2)];
        count[seen[k]] = k;
      }
      for (int i = 0; i < b.n; i++) {
        if (times[i] == 0) continue;
        int k = count[at[i]], to = filled[k]++;
        for (int j = 0; j < f; j++, to += n[k]) made[k][to] = b.x[i * f + j];
        made[k][to] = b.y[i];
        made[k][to + n[k]] = b.w[i] * times[i];
      }
      for (int k = 0; k < nodes; k++) {
        count[seen[k]] = 0;
        byte[] body = new byte[8 * made[k].length];
        little(body).asDoubleBuffer().put(made[k]);
        made[k] = null;
        ready.add(RowFactory.create(new Object[] {Integer.valueOf(draws.tree[t]), Long.valueOf(seen[k]), body}));
      }
      t++;
      return true;
    }
  }

  /** Subtrees of the parts, whose rows follow one another. */
  static class Grow extends Lots {
    final Iterator rows;
    final int f, m, depth;
    final long seed;
    final int[] depthOf;
    Row ahead = null;

    Grow(State s, Iterator rows) {
      this.rows = rows;
      f = s.one();
      m = s.one();
      depth = s.one();
      seed = s.longs()[0];
      depthOf = s.ints();
    }

    boolean more() {
      if (ahead == null) {
        if (!rows.hasNext()) return false;
        ahead = (Row) rows.next();
      }
      int tree = ahead.getInt(0), n = 0;
      long part = ahead.getLong(1);
      ArrayList bodies = new ArrayList();
      while (ahead != null && ahead.getInt(0) == tree && ahead.getLong(1) == part) {
        byte[] body = (byte[]) ahead.get(2);
        bodies.add(body);
        n += body.length / 8 / (f + 2);
        ahead = rows.hasNext() ? (Row) rows.next() : null;
      }
      double[][] columns = new double[f + 2][n];
      int at = 0;
      for (int i = 0; i < bodies.size(); i++) {
        byte[] body = (byte[]) bodies.get(i);
        int own = body.length / 8 / (f + 2);
        ByteBuffer in = little(body);
        for (int j = 0; j < f + 2; j++) {
          in.asDoubleBuffer().get(columns[j], at, own);
          in.position(in.position() + 8 * own);
        }
        at += own;
        bodies.set(i, null);
      }
      int left = depth < 0 ? -1 : depth - depthOf[(int) part];
      Subtree made = new Subtree(columns, n, f, m, left, tree, part, seed);
      ready.add(RowFactory.create(new Object[] {Integer.valueOf(tree), Long.valueOf(part), Long.valueOf(made.size), made.packed()}));
      return true;
    }
  }

  /** A subtree grown to its end from rows that are sorted once by every feature. */
  static class Subtree {
    final int n, f, m, tree;
    final long part, seed;
    final double[][] x;
    final int[][] order;
    final int[] spare;
    final byte[] goes;
    // rows of two classes with one weight each are counted in whole numbers, those of class 1 in the upper half
    long[] counts = null;
    double[] terms = null, y;
    double unit0 = 1, unit1 = 1;
    int size = 0;
    int[] feature = new int[64];
    double[] threshold = new double[64], value = new double[64], weight = new double[64];
    // of the rows looked at last
    double sumW, sumS;
    long sumC;
    boolean impure;

    Subtree(double[][] columns, int n, int f, int m, int depth, int tree, long part, long seed) {
      this.n = n;
      this.f = f;
      this.m = m < 0 || m >= f ? -1 : m;
      this.tree = tree;
      this.part = part;
      this.seed = seed;
      x = columns;
      y = columns[f];
      double[] w = columns[f + 1];
      spare = new int[n];
      goes = new byte[n];
      int[] start = new int[n];
      for (int i = 0; i < n; i++) start[i] = i;
      Radix radix = new Radix(n);
      if (!counted(w)) {
        // equal rows in one order whatever the shuffle made of them, so that sums round alike
        start = radix.sorted(y, radix.sorted(w, start));
        terms = new double[2 * n];
        for (int i = 0; i < n; i++) {
          terms[2 * i] = w[i];
          terms[2 * i + 1] = w[i] * y[i];
        }
      }
      order = new int[f][];
      for (int j = 0; j < f; j++) order[j] = radix.sorted(x[j], start);
      radix = null;
      grow(depth);
    }

    boolean counted(double[] w) {
      double least0 = Double.POSITIVE_INFINITY, least1 = Double.POSITIVE_INFINITY;
      for (int i = 0; i < n; i++) {
        if (y[i] == 0) least0 = Math.min(least0, w[i]);
        else if (y[i] == 1) least1 = Math.min(least1, w[i]);
        else return false;
      }
      long[] found = new long[n];
      double sum0 = 0, sum1 = 0;
      for (int i = 0; i < n; i++) {
        double unit = y[i] == 1 ? least1 : least0, times = Math.rint(w[i] / unit);
        if (!(Math.abs(times * unit - w[i]) <= 1e-14 * Math.abs(w[i]))) return false;
        if (y[i] == 1) sum1 += times; else sum0 += times;
        if (sum0 >= 2147483648.0 || sum1 >= 2147483648.0) return false;
        found[i] = y[i] == 1 ? ((long) times) << 32 : (long) times;
      }
      if (least0 < Double.POSITIVE_INFINITY) unit0 = least0;
      if (least1 < Double.POSITIVE_INFINITY) unit1 = least1;
      counts = found;
      return true;
    }

    int node(double w, double s) {
      if (size == feature.length) {
        feature = Arrays.copyOf(feature, 2 * size);
        threshold = Arrays.copyOf(threshold, 2 * size);
        value = Arrays.copyOf(value, 2 * size);
        weight = Arrays.copyOf(weight, 2 * size);
      }
      feature[size] = -1;
      weight[size] = w;
      value[size] = s / (w > 0 ? w : 1);
      return size++;
    }

    void look(int[] by, int a, int b) {
      if (counts != null) {
        long sum = 0;
        final long[] c = counts;
        for (int i = a; i < b; i++) sum += c[by[i]];
        sumC = sum;
        sumS = unit1 * (double) (sum >>> 32);
        sumW = unit0 * (double) (sum & 0xFFFFFFFFL) + sumS;
        impure = (sum >>> 32) > 0 && (sum & 0xFFFFFFFFL) > 0;
        return;
      }
      final double[] c = terms, v = y;
      final double one = v[by[a]];
      double w = 0, s = 0;
      boolean mixed = false;
      for (int i = a; i < b; i++) {
        int r = by[i];
        w += c[2 * r];
        s += c[2 * r + 1];
        mixed |= v[r] != one;
      }
      sumW = w;
      sumS = s;
      impure = mixed;
    }

    // the best cut of a feature: its gain, and the place of the last row on the left (-1 where there is one value)
    double top;
    int place;

    void cut(int j, int a, int b, double allW, double allS, long all) {
      final int[] by = order[j];
      final double[] v = x[j];
      double most = Double.NEGATIVE_INFINITY;
      int found = -1, r = by[a];
      double here = v[r];
      top = most;
      place = found;
      if (here == v[by[b - 1]]) return;
      if (counts != null) {
        final long[] c = counts;
        final double u0 = unit0, u1 = unit1;
        long sum = 0;
        for (int i = a; i < b - 1; i++) {
          sum += c[r];
          r = by[i + 1];
          double after = v[r];
          if (after != here) {
            here = after;
            long rest = all - sum;
            double sl = u1 * (double) (int) (sum >>> 32), wl = u0 * (double) (int) sum + sl;
            double sr = u1 * (double) (int) (rest >>> 32), wr = u0 * (double) (int) rest + sr;
            double gain = sl * sl / wl + sr * sr / wr;
            if (gain > most || found < 0) {
              most = gain;
              found = i;
            }
          }
        }
      } else {
        final double[] c = terms;
        double wl = 0, sl = 0;
        for (int i = a; i < b - 1; i++) {
          wl += c[2 * r];
          sl += c[2 * r + 1];
          r = by[i + 1];
          double after = v[r];
          if (after != here) {
            here = after;
            double wr = allW - wl, sr = allS - sl, gain = sl * sl / wl + sr * sr / wr;
            if (gain > most || found < 0) {
              most = gain;
              found = i;
            }
          }
        }
      }
      top = most;
      place = found;
    }

    /** Numbers the rows anew so that those of a node lie together: a node's rows are then read from nearby. */
    void gather(int[] from, int[] to, boolean[] open, int[] via, boolean[] flat, int k) {
      int rows = 0;
      for (int o = 0; o < k; o++) if (open[o]) rows += to[o] - from[o];
      int[] old = new int[rows], name = spare;
      int at = 0;
      for (int o = 0; o < k; o++) {
        if (!open[o]) continue;
        int[] by = order[via[o]];
        for (int i = from[o]; i < to[o]; i++) {
          name[by[i]] = at;
          old[at++] = by[i];
        }
      }
      for (int j = 0; j < f; j++) {
        int[] of = order[j], made = new int[rows];
        double[] v = x[j], own = new double[rows];
        for (int i = 0; i < rows; i++) own[i] = v[old[i]];
        at = 0;
        for (int o = 0; o < k; o++) {
          if (!open[o]) continue;
          if (flat[o * f + j]) at += to[o] - from[o];  // not read any more
          else for (int i = from[o]; i < to[o]; i++) made[at++] = name[of[i]];
        }
        x[j] = own;
        order[j] = made;
      }
      double[] labels = new double[rows];
      for (int i = 0; i < rows; i++) labels[i] = y[old[i]];
      y = labels;
      if (counts != null) {
        long[] own = new long[rows];
        for (int i = 0; i < rows; i++) own[i] = counts[old[i]];
        counts = own;
      } else {
        double[] own = new double[2 * rows];
        for (int i = 0; i < rows; i++) {
          own[2 * i] = terms[2 * old[i]];
          own[2 * i + 1] = terms[2 * old[i] + 1];
        }
        terms = own;
      }
      at = 0;
      for (int o = 0; o < k; o++) {
        if (!open[o]) continue;
        int own = to[o] - from[o];
        from[o] = at;
        at += own;
        to[o] = at;
      }
    }

    final long[] hashes = new long[256];

    /** The features of a node in their random order. */
    void draw(long node, int[] out) {
      long[] h = f <= hashes.length ? hashes : new long[f];
      long base = node * 0x9E3779B97F4A7C15L + (seed * 1000003L + tree);
      for (int j = 0; j < f; j++) {
        long k = base + (j + 1) * 0xC2B2AE3D27D4EB4FL;
        k = (k ^ (k >>> 30)) * 0xBF58476D1CE4E5B9L;
        k = (k ^ (k >>> 27)) * 0x94D049BB133111EBL;
        k = (k ^ (k >>> 31)) + Long.MIN_VALUE;
        int at = j;
        while (at > 0 && h[at - 1] > k) {
          h[at] = h[at - 1];
          out[at] = out[at - 1];
          at--;
        }
        h[at] = k;
        out[at] = j;
      }
    }

    /** The rows that go left, then those that go right, each in their order. */
    void part(int[] of, int a, int middle, int b) {
      final byte[] goes = this.goes;
      final int[] spare = this.spare;
      int here = a, there = 0;
      for (int i = a; i < b; i++) {
        int r = of[i], side = goes[r];
        // both are written, one is kept
        of[here] = r;
        spare[there] = r;
        here += side;
        there += 1 - side;
      }
      System.arraycopy(spare, 0, of, middle, there);
    }

    void grow(int depth) {
      int k = 1, level = 0;
      int[] from = {0}, to = {n}, tried = new int[f];
      look(order[0], 0, n);
      double[] w = {sumW}, s = {sumS};
      long[] c = {sumC};
      boolean[] open = {impure && depth != 0}, flat = new boolean[f];
      int[] via = {0};
      node(sumW, sumS);
      while (true) {
        int first = size - k, splits = 0, opened = 0;
        for (int o = 0; o < k; o++) if (open[o]) opened++;
        if (level % 4 == 3 && opened > 0) gather(from, to, open, via, flat, k);
        long[] c2 = new long[2 * opened];
        int[] via2 = new int[2 * opened];
        int[] from2 = new int[2 * opened], to2 = new int[2 * opened];
        double[] w2 = new double[2 * opened], s2 = new double[2 * opened];
        boolean[] open2 = new boolean[2 * opened], flat2 = new boolean[2 * opened * f];
        for (int o = 0; o < k; o++) {
          if (!open[o]) continue;
          int a = from[o], b = to[o], bestJ = f, bestPlace = -1, got = 0;
          double best = Double.NEGATIVE_INFINITY;
          if (m >= 0) draw(part * 1000003L + (first + o), tried);
          for (int p = 0; p < f && (m < 0 || got < m); p++) {
            int j = m < 0 ? p : tried[p];
            if (flat[o * f + j]) continue;
            cut(j, a, b, w[o], s[o], c[o]);
            if (place < 0) {
              flat[o * f + j] = true;
              continue;
            }
            got++;
            if (top > best || (top == best && j < bestJ)) {
              best = top;
              bestJ = j;
              bestPlace = place;
            }
          }
          if (bestJ == f) continue;
          int[] by = order[bestJ];
          int middle = bestPlace + 1, left = 2 * splits++;
          double low = x[bestJ][by[bestPlace]], high = x[bestJ][by[middle]], t = (low + high) / 2;
          feature[first + o] = bestJ;
          threshold[first + o] = t >= high || Double.isNaN(t) || Double.isInfinite(t) ? low : t;
          boolean deeper = depth < 0 || level + 1 < depth;
          for (int side = left; side < left + 2; side++) {
            from2[side] = side == left ? a : middle;
            to2[side] = side == left ? middle : b;
            look(by, from2[side], to2[side]);
            w2[side] = sumW;
            s2[side] = sumS;
            c2[side] = sumC;
            via2[side] = bestJ;
            open2[side] = impure && deeper;
            node(sumW, sumS);
            System.arraycopy(flat, o * f, flat2, side * f, f);
          }
          if (!open2[left] && !open2[left + 1]) continue;
          for (int i = a; i < middle; i++) goes[by[i]] = 1;
          for (int i = middle; i < b; i++) goes[by[i]] = 0;
          for (int j = 0; j < f; j++) {
            if (j != bestJ && !flat[o * f + j]) part(order[j], a, middle, b);
          }
        }
        if (splits == 0) return;
        k = 2 * splits;
        from = from2;
        to = to2;
        w = w2;
        s = s2;
        c = c2;
        via = via2;
        open = open2;
        flat = flat2;
        level++;
      }
    }

    byte[] packed() {
      int inner = 0;
      boolean small = true;
      for (int i = 0; i < size; i++) {
        if (feature[i] >= 0) inner++;
        if ((double) (float) weight[i] != weight[i]) small = false;
      }
      int wide = f > 127 ? 4 : 1;
      byte[] body = new byte[1 + size * (wide + 8 + (small ? 4 : 8)) + 8 * inner];
      ByteBuffer out = little(body);
      out.put((byte) ((wide == 4 ? 1 : 0) + (small ? 0 : 2)));
      for (int i = 0; i < size; i++) {
        if (wide == 4) out.putInt(feature[i]); else out.put((byte) feature[i]);
      }
      for (int i = 0; i < size; i++) out.putDouble(feature[i] < 0 ? value[i] : threshold[i]);
      for (int i = 0; i < size; i++) if (feature[i] >= 0) out.putDouble(value[i]);
      for (int i = 0; i < size; i++) {
        if (small) out.putFloat((float) weight[i]); else out.putDouble(weight[i]);
      }
      return body;
    }
  }

  /** Row numbers sorted by a column; rows with equal values keep their order. */
  static class Radix {
    final int n;
    final int[][] count = new int[6][2048];
    long[] key, other;

    Radix(int n) {
      this.n = n;
      key = new long[n];
      other = new long[n];
    }

    int[] sorted(double[] column, int[] by) {
      for (int d = 0; d < 6; d++) Arrays.fill(count[d], 0);
      int[] row = Arrays.copyOf(by, n), to = new int[n];
      for (int i = 0; i < n; i++) {
        long bits = Double.doubleToLongBits(column[row[i]] + 0.0);
        bits ^= (bits >> 63) | Long.MIN_VALUE;
        key[i] = bits;
        for (int d = 0; d < 6; d++) count[d][(int) (bits >>> (11 * d)) & 2047]++;
      }
      for (int d = 0; d < 6 && n > 0; d++) {
        int[] c = count[d];
        int shift = 11 * d;
        if (c[(int) (key[0] >>> shift) & 2047] == n) continue;
        for (int i = 0, sum = 0; i < 2048; i++) {
          int own = c[i];
          c[i] = sum;
          sum += own;
        }
        for (int i = 0; i < n; i++) {
          int at = c[(int) (key[i] >>> shift) & 2047]++;
          other[at] = key[i];
          to[at] = row[i];
        }
        long[] keys = key;
        key = other;
        other = keys;
        int[] rows = row;
        row = to;
        to = rows;
      }
      return row;
    }
  }

  /** Which bundle of this run each part is in, or -1; parts are in the order of their names. */
  static class Home {
    final int[] parts, bundles;
    final int blocks;

    Home(State s) {
      parts = s.ints();
      bundles = s.ints();
      blocks = s.one();
    }

    int of(int part) {
      return bundles[Arrays.binarySearch(parts, part)];
    }
  }

  /** Parts for scoring: features, thresholds and leaf values, once for each block of rows. */
  static class Bundle extends Lots {
    final Iterator rows;
    final Home home;

    Bundle(State s, Iterator rows) {
      this.rows = rows;
      home = new Home(s);
    }

    boolean more() {
      if (!rows.hasNext()) return false;
      Row r = (Row) rows.next();
      int part = (int) r.getLong(1), n = (int) r.getLong(2);
      if (home.of(part) < 0) return true;
      byte[] body = (byte[]) r.get(3);
      body = Arrays.copyOf(body, 1 + n * (((body[0] & 1) != 0 ? 4 : 1) + 8));
      for (int block = 0; block < home.blocks; block++) {
        ready.add(RowFactory.create(new Object[] {Integer.valueOf(home.of(part)), Integer.valueOf(block), Integer.valueOf(0),
                                                  Integer.valueOf(part), Integer.valueOf(n), body}));
      }
      return true;
    }
  }

  /** Rows sent down the nodes above the parts: to the bundles of the parts they need; values of leaves are added up. */
  static class Route extends Lots {
    final Iterator rows;
    final int f, bundles;
    final Nodes top;
    final double[] value;
    final int[] start;
    final Home home;
    final boolean ends;  // whether this run adds up the leaves above the parts

    Route(State s, Iterator rows) {
      this.rows = rows;
      f = s.one();
      top = new Nodes(s);
      value = s.doubles();
      start = s.ints();
      home = new Home(s);
      int most = 0;
      for (int k = 0; k < home.bundles.length; k++) most = Math.max(most, home.bundles[k] + 1);
      bundles = most;
      ends = s.one() != 0;
    }

    boolean more() {
      if (!rows.hasNext()) return false;
      Block b = new Block((Row) rows.next(), f, false);
      double[] done = new double[b.n];
      int keys = bundles * home.blocks;
      int[][] pairRow = new int[keys][], pairPart = new int[keys][];
      int[] filled = new int[keys], at = new int[b.n], order = new int[b.n];
      int parts = home.parts.length;
      int[] count = new int[parts + 1], which = new int[b.n];
      for (int t = 0; t < start.length; t++) {
        int pairs = 0;
        Arrays.fill(count, 0);
        for (int i = 0; i < b.n; i++) {
          int node = top.end(b.x, i * f, start[t]);
          if (node >= 0) {
            done[i] += value[node];
          } else {
            int k = -2 - node;
            if (home.bundles[k] < 0) continue;
            at[pairs] = i;
            which[pairs++] = k;
            count[k + 1]++;
          }
        }
        // a part's rows follow one another
        for (int k = 0; k < parts; k++) count[k + 1] += count[k];
        for (int i = 0; i < pairs; i++) order[count[which[i]]++] = i;
        for (int i = 0; i < pairs; i++) {
          int row = at[order[i]], k = which[order[i]];
          int key = home.bundles[k] * home.blocks + (int) (b.id[row] % home.blocks);
          if (pairRow[key] == null) {
            pairRow[key] = new int[256];
            pairPart[key] = new int[256];
          } else if (filled[key] == pairRow[key].length) {
            pairRow[key] = Arrays.copyOf(pairRow[key], 2 * filled[key]);
            pairPart[key] = Arrays.copyOf(pairPart[key], 2 * filled[key]);
          }
          pairRow[key][filled[key]] = row;
          pairPart[key][filled[key]++] = home.parts[k];
        }
      }
      byte[] body;
      ByteBuffer out;
      if (ends && b.n > 0) {
        body = new byte[12 + 16 * b.n];
        out = little(body);
        out.putInt(b.n).putInt(0).putInt(0);
        out.asLongBuffer().put(b.id);
        out.position(12 + 8 * b.n);
        out.asDoubleBuffer().put(done);
        ready.add(RowFactory.create(new Object[] {Integer.valueOf(-1), Integer.valueOf((int) (b.id[0] % 64)), Integer.valueOf(1),
                                                  Integer.valueOf(0), Integer.valueOf(0), body}));
      }
      int[] local = new int[b.n];
      Arrays.fill(local, -1);
      for (int key = 0; key < keys; key++) {
        if (filled[key] == 0) continue;
        int some = 0;
        int[] distinct = new int[Math.min(b.n, filled[key])];
        for (int i = 0; i < filled[key]; i++) {
          int row = pairRow[key][i];
          if (local[row] < 0) {
            local[row] = some;
            distinct[some++] = row;
          }
        }
        int runs = 0;
        for (int i = 0; i < filled[key]; i++) if (i == 0 || pairPart[key][i] != pairPart[key][i - 1]) runs++;
        body = new byte[12 + some * 8 * (f + 1) + 4 * filled[key] + 8 * runs];
        out = little(body);
        out.putInt(some).putInt(filled[key]).putInt(runs);
        for (int i = 0; i < some; i++) out.putLong(b.id[distinct[i]]);
        for (int i = 0; i < some; i++) for (int j = 0; j < f; j++) out.putDouble(b.x[distinct[i] * f + j]);
        for (int i = 0; i < filled[key]; i++) out.putInt(local[pairRow[key][i]]);
        // the part of each run of pairs, and where it starts
        for (int i = 0; i < filled[key]; i++) if (i == 0 || pairPart[key][i] != pairPart[key][i - 1]) out.putInt(pairPart[key][i]).putInt(i);
        for (int i = 0; i < some; i++) local[distinct[i]] = -1;
        pairRow[key] = null;
        pairPart[key] = null;
        ready.add(RowFactory.create(new Object[] {Integer.valueOf(key / home.blocks), Integer.valueOf(key % home.blocks),
                                                  Integer.valueOf(1), Integer.valueOf(0), Integer.valueOf(0), body}));
      }
      return true;
    }
  }

  /** The parts of a bundle, then the rows that need them: sums of leaf values by row, dealt into ranges of rows. */
  static class Meet extends Lots {
    final Iterator rows;
    final int f, ranges;
    int bundle = -2, block = -2, size = 0, parts = 0;
    int[] feature = new int[1024], left = new int[1024], part = new int[64], base = new int[64];
    double[] number = new double[1024];

    Meet(State s, Iterator rows) {
      this.rows = rows;
      f = s.one();
      ranges = s.one();
    }

    void add(int name, int n, byte[] body) {
      if (size + n > feature.length) {
        int room = Math.max(2 * feature.length, size + n);
        feature = Arrays.copyOf(feature, room);
        left = Arrays.copyOf(left, room);
        number = Arrays.copyOf(number, room);
      }
      if (parts == part.length) {
        part = Arrays.copyOf(part, 2 * parts);
        base = Arrays.copyOf(base, 2 * parts);
      }
      // names in order, so that they are found by halving
      int at = parts++;
      while (at > 0 && part[at - 1] > name) {
        part[at] = part[at - 1];
        base[at] = base[at - 1];
        at--;
      }
      part[at] = name;
      base[at] = size;
      ByteBuffer in = little(body);
      boolean wide = (in.get() & 1) != 0;
      int inner = 0;
      for (int i = 0; i < n; i++) {
        int j;
        if (wide) j = in.getInt(); else j = in.get();
        feature[size + i] = j;
        left[size + i] = j < 0 ? -1 : size + 2 * inner++ + 1;
      }
      in.asDoubleBuffer().get(number, size, n);
      size += n;
    }

    /** Rows of a run sent down one part, their leaf's value added to the row's sum. */
    void down(int root, double[] x, int[] row, int start, int stop, double[] sum) {
      final int[] feature = this.feature, left = this.left;
      final double[] number = this.number;
      for (int i = start; i < stop; i++) {
        int at = root, x0 = row[i] * f;
        for (int j = feature[at]; j >= 0; j = feature[at]) at = x[x0 + j] <= number[at] ? left[at] : left[at] + 1;
        sum[row[i]] += number[at];
      }
    }

    boolean more() {
      if (!rows.hasNext()) return false;
      Row r = (Row) rows.next();
      if (r.getInt(0) != bundle || r.getInt(1) != block) {
        bundle = r.getInt(0);
        block = r.getInt(1);
        size = 0;
        parts = 0;
      }
      byte[] body = (byte[]) r.get(5);
      if (r.getInt(2) == 0) {
        add(r.getInt(3), r.getInt(4), body);
        return true;
      }
      ByteBuffer in = little(body);
      int n = in.getInt(), pairs = in.getInt(), runs = in.getInt();
      long[] id = TreeSteps.longs(in, n);
      double[] sum;
      if (bundle < 0) {
        sum = TreeSteps.doubles(in, n);
      } else {
        double[] x = TreeSteps.doubles(in, n * f);
        int[] row = TreeSteps.ints(in, pairs), run = TreeSteps.ints(in, 2 * runs);
        sum = new double[n];
        for (int k = 0; k < runs; k++) {
          int stop = k + 1 < runs ? run[2 * k + 3] : pairs;
          down(base[Arrays.binarySearch(part, 0, parts, run[2 * k])], x, row, run[2 * k + 1], stop, sum);
        }
      }
      int[] count = new int[ranges];
      for (int i = 0; i < n; i++) count[(int) (id[i] % ranges)]++;
      ByteBuffer[] out = new ByteBuffer[ranges];
      for (int k = 0; k < ranges; k++) if (count[k] > 0) out[k] = little(new byte[16 * count[k]]);
      for (int i = 0; i < n; i++) out[(int) (id[i] % ranges)].putLong(id[i]);
      for (int i = 0; i < n; i++) out[(int) (id[i] % ranges)].putDouble(sum[i]);
      for (int k = 0; k < ranges; k++) {
        if (count[k] > 0) ready.add(RowFactory.create(new Object[] {Integer.valueOf(k), out[k].array()}));
      }
      return true;
    }
  }
}
"""

_COMPILING = threading.Lock()


def _loaded(spark: SparkSession):
    """The class, compiled and shipped once per application."""
    sc, jvm = spark.sparkContext, spark._jvm
    with _COMPILING:  # models may be fitted in several threads
        if getattr(sc, "_cindergrid_trees", None) is None:
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(SOURCE)
            made = compiler.getBytecodes()
            path = os.path.join(tempfile.mkdtemp(prefix="cindergrid-code-"), "cindergrid-trees.jar")
            with zipfile.ZipFile(path, "w") as archive:
                for name in made:
                    archive.writestr(name.replace(".", "/") + ".class", bytes(made[name]))
            sc._jsc.addJar(path)
            urls = sc._gateway.new_array(jvm.java.net.URL, 1)
            urls[0] = jvm.java.io.File(path).toURI().toURL()
            loader = jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader())
            sc._cindergrid_trees = loader.loadClass(CLASS).getConstructors()[0]
        return sc._cindergrid_trees


def long(numbers) -> np.ndarray:
    """Whole numbers of 8 bytes for :func:`state`."""
    return np.atleast_1d(np.asarray(numbers, np.int64)).view(np.uint64)


def state(*arrays) -> bytes:
    """Arrays one after another, each behind its length; whole numbers take 4 bytes unless they are :func:`long`."""
    out = []
    for a in arrays:
        a = np.atleast_1d(a)
        if a.dtype != np.uint64 and a.dtype.kind in "iub":
            a = a.astype("<i4")
        out += [np.int32(len(a)).tobytes(), np.ascontiguousarray(a).tobytes()]
    return b"".join(out)


def run(df: DataFrame, step: str, body: bytes, schema: str) -> DataFrame:
    """``df`` sent through one step of the class, with ``body`` (see :func:`state`) shared by all tasks."""
    spark = df.sparkSession
    sc, jvm = spark.sparkContext, spark._jvm
    made = _loaded(spark)
    args = sc._gateway.new_array(jvm.java.lang.Object, 2)
    args[0], args[1] = step, sc._jsc.broadcast(body)
    encoder = jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.StructType.fromDDL(schema))
    return DataFrame(df._jdf.mapPartitions(made.newInstance(args), encoder), spark)
