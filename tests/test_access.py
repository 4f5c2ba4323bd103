"""Guards, ownership checks and upload handlers: every shape, and what isn't one."""

from sightline.operators import access, context


def lines(spark, files):
    rows = [(p, i, t) for p, ls in files.items() for i, t in enumerate(ls, 1)]
    return spark.createDataFrame(rows, "path string, line int, text string")


def test_guards(spark):
    files = {
        "a.py": ["@login_required", "@other", "@admin_required(role='x')", "def f():", "  pass", "@protected", "", "def g(u=Depends(get_u), d=depends( db.get(1) )):", "@jwt_required", "class C:", "@app.route('/x')", "async def h():"],
        "app/settings.py": ["A = ['x.Y']", "MIDDLEWARE = ['not.this'", "  'a.B', 'c.D',", "  \"e.F\" ]", "'g.H'"],
        "app/views.py": ["MIDDLEWARE = [", "'a.B',", "]"],
        "conf/CONFIG.PY": ["MIDDLEWARE = [", "'x.Y',", "'z.W'"],
        "s.ts": ["app.use(auth)", "router.use('/a', guard)", "Router.USE( x )", "app.use(cors())", "app.used(x)", "@login_required"],
        "g.go": ["app.use(auth)", "Depends(x)"],
    }
    got = {tuple(r) for r in access.guards(lines(spark, files)).collect()}
    assert got == {
        ("a.py", 1, "decorator", "login_required"),
        ("a.py", 3, "decorator", "admin_required(role='x')"),
        ("a.py", 8, "Depends", "Depends(get_u)"),
        ("a.py", 8, "Depends", "Depends(db.get(1))"),
        ("app/settings.py", 3, "django_middleware", "a.B"),
        ("app/settings.py", 3, "django_middleware", "c.D"),
        ("conf/CONFIG.PY", 2, "django_middleware", "x.Y"),
        ("conf/CONFIG.PY", 3, "django_middleware", "z.W"),
        ("s.ts", 1, "app.use", "auth"),
        ("s.ts", 2, "app.use", "d"),  # as the fixed shape has it: what stands before takes all it can
        ("s.ts", 3, "app.use", "x"),
    }


def test_long_files_of_decorators(spark):
    n = 60_000
    df = spark.range(n).selectExpr("'f.py' AS path", "cast(id + 1 AS int) AS line", "CASE WHEN id % 3 = 2 THEN 'def f():' ELSE '@login_required' END AS text")
    assert access.guarding_decorators(df).count() == n // 3 * 2


def test_ownership_checks(spark):
    rows = {
        "WHERE user_id = current_user.id": [("WHERE user_id =", "user_id", True), ("current_user.id", "current_user.id", True)],
        "select * where Tenant_Id = request.args['t'] and x": [("WHERE Tenant_Id =", "Tenant_Id", False)],
        "WHERE owner_id = ? AND WHERE org_id = 5;": [("WHERE owner_id =", "owner_id", False), ("WHERE org_id =", "org_id", False)],
        "WHERE name = 1": [],
        "@require_admin": [("require_admin", "require_admin", True)],
        "require_loginx": [],
        "can_read(x) or has_permission (request.user.pk)": [("can_read", "can_read", True), ("has_permission", "has_permission", True), ("current_user.id", "current_user.id", True)],
        "can_delete(x)": [("can_delete", "can_delete", False)],
        "if a == current_user.name": [],
        "u = Depends( get_current_user )": [("Depends(get_current_user)", "get_current_user", True)],
    }
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(rows)], "path string, line int, text string")
    got = {}
    for r in access.ownership_checks(df).collect():
        got.setdefault(r.line, []).append((r.pattern, r.identifier, r.current_user_derived))
    for i, (text, want) in enumerate(rows.items()):
        assert sorted(got.get(i, [])) == sorted(want), text


def test_upload_handlers(spark):
    files = {
        "a.py": ["request.FILES['x']", "def up(f: UploadFile = File(...)):", "  f = request.files['a']", "multipart.parse_form_data(x)", "save_file(upload)", "Request.files"],
        "b.tsx": ["const go = async (req) => 1", "  multer({})", "upload.array('f')", "function named() { req.file; req.files }", "new Busboy({})", "new formidable.IncomingForm()", "formidable.parse(x)", "var x = (", "req.file"],
        "c.go": ["func (s *S) Put(w W) {", "  r.FormFile(n)", "  c.FormFile(n)", "  r.MultipartForm", "  multipart.NewReader(x)", "  io.Copy(multipart)"],
        "d.rb": ["request.files"],
        "e.py": ["def far():"] + ["x"] * 49 + ["request.files"],
    }
    got = [tuple(r) for r in access.upload_handlers(lines(spark, files)).collect()]
    assert got == [
        ("a.py", 3, "flask", "up"),
        ("a.py", 2, "fastapi", "up"),
        ("a.py", 1, "django", "<module>"),
        ("a.py", 4, "multipart", "up"),
        ("a.py", 5, "flask", "up"),
        ("b.tsx", 2, "multer", "go"),
        ("b.tsx", 3, "multer", "go"),
        ("b.tsx", 4, "express", "named"),
        ("b.tsx", 9, "express", "x"),
        ("b.tsx", 5, "busboy", "named"),
        ("b.tsx", 6, "formidable", "named"),
        ("b.tsx", 7, "formidable", "named"),
        ("c.go", 2, "gin", "Put"),
        ("c.go", 4, "go_multipart", "Put"),
        ("c.go", 5, "go_multipart", "Put"),
        ("c.go", 6, "go_multipart", "Put"),
        ("c.go", 3, "go_multipart", "Put"),
        ("e.py", 51, "flask", "<module>"),
    ]
    assert [tuple(r)[:2] for r in access.upload_handlers(lines(spark, files), 2).collect()] == [("a.py", 3), ("a.py", 2)]


def test_upload_context(spark):
    files = {
        "a.py": ["@app.route('/up')", "@login_required", "def up():", "  f = request.files['f']", "  if magic.from_buffer(b) and f.mimetype == 'x' and f.filename.endswith('.png'):", "  zipfile.ZipFile(f).extractall(os.path.abspath(d))", "  open('/var/x' + str(uuid.uuid4()))", "  WHERE user_id = current_user.id", "MAX_FILE_SIZE = 1"],
        "b.py": ["x", "request.files"] + ["y"] * 70 + ["yaml.load(z)", "send_file(filename)"],
        "c.py": ["request.FILES", "yaml.load(z)  # unsafe", "tarfile.open(z)", "x = f.mimetype", "'uploads/' + n", "DENY_EXT"],
    }
    ls = lines(spark, files)
    got = {(r.path): r for r in access.upload_context(access.upload_handlers(ls), ls, context.routes(ls)).collect()}
    a, b, c = got["a.py"], got["b.py"], got["c.py"]
    assert a.route_summary == ["GET /up → up"] and a.middleware_summary == ["login_required"]
    assert a.authz_signals == ["WHERE user_id = (current_user-derived: True)", "current_user.id (current_user-derived: True)"]
    assert a.overall_summary == "Validation: magic-bytes | extension-allowlist — Naming: server-generated | preserved-user-filename — Storage: outside-webroot — Limits: yes — Access: yes — Processing: archive-extract-with-containment"
    assert b.overall_summary == "Validation: none — Naming: unknown — Storage: unknown — Limits: none — Access: none — Processing: none" and b.retrieval_signals == ["direct-by-filename"]
    assert c.overall_summary == "Validation: MIME-only | blocklist — Naming: unknown — Storage: public-path — Limits: none — Access: none — Processing: archive-extract | risky-parser" and c.retrieval_signals == ["none"]
