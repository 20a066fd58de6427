"""Developer loop: python tests/check_queries.py SF_DIR [substring ...]"""
import sys, time, traceback
sys.path.insert(0, "/root/repo"); sys.path.insert(0, "/root/repo/tests")
from compare import connect, check
from pitlens.session import local_session
from pitlens.plans import QUERIES
from pitlens.plans.registry import runner

if __name__ == "__main__":
    sf, pats = sys.argv[1], sys.argv[2:]
    spark = local_session(8); con = connect(sf); bad = []
    for name, q in QUERIES.items():
        if pats and not any(p == name or q.build.__module__.endswith(p) for p in pats):
            continue
        t = time.time(); ts = 0
        try:
            df = runner(q)(spark, sf)
            if q.sql:
                rows = df.collect(); ts = time.time() - t
                err = check(con, df, q.sql, rows); n = ""
            else:
                n = f"rows={len(df.collect())}"; err = None
        except Exception as e:
            err = str(e)[:900] if not isinstance(e, KeyboardInterrupt) else "int"
        dt = time.time() - t
        if err or ts > 3 or n:
            print(f"{'FAIL' if err else 'ok  '} {name} {ts:.1f}s/{dt-ts:.1f}s {n} {err or ''}", flush=True)
        if err: bad.append(name)
    print("bad:", bad)
