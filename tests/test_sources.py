from windlass.sources import sinks, text


def _file(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


def test_conversations(spark, tmp_path):
    path = _file(tmp_path, "c", "====\nIPv4 Conversations\n  | <- | ->\n10.0.0.1 <-> 172.17.0.18 1870 259473 1569 3434181 3439 3693654 0.000472000 9.9987\n")
    (r,) = text.conversations(spark, path).collect()
    assert (r.addr_a, r.addr_b, r.frames_ba, r.bytes_ba, r.frames_ab, r.bytes_ab, r.rel_start, r.duration) == ("10.0.0.1", "172.17.0.18", 1870, 259473, 1569, 3434181, 0.000472, 9.9987)


def test_cluster_tables(spark, tmp_path):
    pods = _file(tmp_path, "p", "NAMESPACE NAME READY STATUS RESTARTS AGE IP NODE\nd a-1 1/1 Running 0 1h 10.1.0.1 n\nd b-1 1/1 Running 0 1h 10.1.0.1 n\n")
    assert {(r.ip, r.name) for r in text.pods(spark, pods).collect()} == {("IP", "NAME"), ("10.1.0.1", "a-1;b-1")}
    svcs = _file(tmp_path, "s", "NAMESPACE NAME TYPE CLUSTER-IP EXTERNAL-IP PORT(S) AGE\nd web LB 10.9.8.7 <pending> 80:32209/TCP,443/TCP 1h\nd head C None <none> 3306/TCP 1h\n")
    assert sorted((r.name, r.ip, r.port, r.node_port, r.protocol) for r in text.service_table(spark, svcs).collect() if r.name == "web_VIP") == [("web_VIP", "10.9.8.7", 80, 32209, "TCP"), ("web_VIP", "10.9.8.7", 443, None, "TCP")]
    assert text.service_table(spark, svcs).filter("name = 'head_VIP' and ip is null").count() == 1


def test_networks(spark, tmp_path):
    one = '[\n {"Name": "net", "IPAM": {"Config": [{"Subnet": "10.0.0.0/24", "Gateway": "10.0.0.1/24"}]}, "Containers": {"x": {"Name": "app.1.abc", "IPv4Address": "10.0.0.5/24"}}}\n]\n'
    path = _file(tmp_path, "n", one + one.replace('"net"', '"other"').replace(', "Gateway": "10.0.0.1/24"', ""))
    assert {(r.network, r.ip, r.name) for r in text.networks(spark, path).collect()} == {("net", "10.0.0.5", "app.1"), ("other", "10.0.0.5", "app.1"), ("net", "10.0.0.1", "net_gateway")}


def test_edge_files(spark, tmp_path):
    path = _file(tmp_path, "e", "a b {'frames':3,'weight':700}\nb a {'frames':0,'weight':0}\nbroken\n")
    assert {(r.src, r.dst, r.frames, r.weight) for r in text.edge_file(spark, path).collect()} == {("a", "b", 3, 700), ("b", "a", 0, 0)}
    df = spark.createDataFrame([(10, "a", "b", 3, 700)], "gran int, src string, dst string, frames long, weight long")
    sinks.edge_files(df, str(tmp_path / "out"))
    assert text.edge_file(spark, str(tmp_path / "out" / "gran=10")).select("src", "weight").first() == ("a", 700)


def test_policy(spark, tmp_path):
    path = _file(tmp_path, "pol", "# c\na ALLOWED b\nc ALLOWED all\n-----\na b_vip\nALL c_vip # x\n")
    allowed, pairs = text.policy(spark, path)
    assert {(r.src, r.dst) for r in allowed.collect()} == {("a", "b"), ("b", "a"), ("c", "a"), ("c", "b"), ("a", "c"), ("b", "c")}
    assert {(r.src, r.vip_of) for r in pairs.collect()} == {("a", "b_vip"), ("ALL", "c_vip")}


def test_facts_csv_and_logs(spark, tmp_path):
    path = _file(tmp_path, "f", "x\n  hacl('a',b,tcp,80) and more\nhacl(a,b,tcp,80)\n")
    assert text.reachability(spark, path).collect() == [("a", "b", "tcp", "80")]
    frame = text.feature_csv(spark, _file(tmp_path, "g.csv", ",m\n0,1.5\n10,?\n"))
    assert frame.columns == ["time", "m"] and [r.m for r in frame.orderBy("time").collect()] == [1.5, None]
    assert text.load_test_totals(spark, _file(tmp_path, "l.csv", "Method,Name,n,f\nNone,Total,10,2\nNone,x,y,1\nGET,a,4,1\n")).first() == (10, 2, 0.2)
    logs = tmp_path / "logs"
    logs.mkdir()
    _file(logs, "good", "web 2/2 up\n")
    _file(logs, "bad", "web 0/2 up\n")
    assert {r.file.rsplit("/", 1)[1]: r.problem for r in text.log_problems(spark, str(logs)).collect()} == {"good": False, "bad": True}
    assert "<td>1</td>" in sinks.html_table(spark.createDataFrame([(1,)], "a int"))
