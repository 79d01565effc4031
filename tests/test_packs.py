"""Each rule of the packs by language finds its example and leaves the harmless one alone."""

from gritstone.operators import scan
from gritstone.rules.load import lint, read_packs

# (slug, path, a text with one weakness, a harmless one)
EXAMPLES = [
    ('py-unpickle', 'a.py', 'x = pickle.loads(body)', 'x = json.loads(body)'),
    ('py-yaml-full-load', 'a.py', 'yaml.load(f)', 'yaml.safe_load(f)'),
    ('py-sql-built-text', 'a.py', 'cur.execute(f"select {x}")', 'cur.execute("select 1", [x])'),
    ('py-tls-unverified', 'a.py', 'requests.get(u, verify=False)', 'requests.get(u, verify=True)'),
    ('py-debug-server', 'a.py', 'app.run(debug=True)', 'app.run(debug=False)'),
    ('py-csrf-off', 'a.py', '@csrf_exempt\ndef f(): pass', 'def f(): pass'),
    ('py-template-from-text', 'a.py', 'render_template_string(x)', "render_template('a.html')"),
    ('py-xml-entities', 'a.py', 'etree.parse(f)', 'json.load(f)'),
    ('py-temp-name', 'a.py', 'tempfile.mktemp()', 'tempfile.mkstemp()'),
    ('py-archive-all', 'a.py', 't.extractall(d)', 't.getnames()'),
    ('py-outbound-input', 'a.py', "u = request.args['u']\nrequests.get(u)", "requests.get('https://a.example')"),
    ('py-path-input', 'a.py', "p = request.args['p']\nopen(p)", "open('a.txt')"),
    ('py-route', 'a.py', "@app.post('/x')\ndef f(): pass", 'def f(): pass'),
    ('py-assert-guard', 'a.py', 'assert user.is_admin', 'if not user.is_admin: raise X'),
    ('js-dynamic-code', 'a.js', 'eval(x)', 'evaluate(x)'),
    ('js-child-shell', 'a.js', 'exec(`ls ${x}`)', "execFile('ls', [x])"),
    ('js-react-raw-html', 'a.tsx', '<p dangerouslySetInnerHTML={{__html: x}}/>', '<p>{x}</p>'),
    ('js-proto-merge', 'a.js', '_.merge(a, req.body)', 'Object.assign({}, a)'),
    ('js-regex-from-input', 'a.js', 'q = req.query.q\nnew RegExp(q)', "new RegExp('a+')"),
    ('js-cors-any', 'a.js', "cors({origin: '*'})", "cors({origin: 'https://a.example'})"),
    ('js-token-unverified', 'a.js', 'jwt.decode(t)', 'jwt.verify(t, k)'),
    ('js-weak-random', 'a.js', 'const token = Math.random()', 'const x = Math.random()'),
    ('js-cookie-plain', 'a.js', "res.cookie('a', b, {httpOnly: false})", "res.cookie('a', b, {httpOnly: true})"),
    ('js-tls-off', 'a.js', '{rejectUnauthorized: false}', '{rejectUnauthorized: true}'),
    ('js-fetch-input', 'a.js', 'const u = req.query.u\nfetch(u)', "fetch('/x')"),
    ('js-file-input', 'a.js', 'p = req.params.p\nres.sendFile(p)', "fs.readFile('a')"),
    ('js-express-route', 'a.js', "app.post('/x', f)", "post('/x')"),
    ('js-nest-route', 'a.ts', "@Post('x')\nf() {}", 'f() {}'),
    ('js-resolver', 'a.ts', 'const resolvers = {', 'const r = {'),
    ('js-introspection', 'a.ts', '{introspection: true}', '{introspection: false}'),
    ('js-socket-origin', 'a.js', 'new WebSocketServer({port: 1})', 'new WebSocket(u)'),
    ('js-next-action', 'a.ts', "'use server'", "'use client'"),
    ('js-next-route', 'app/api/route.ts', 'export async function POST(r) {}', 'export const x = 1'),
    ('js-post-message', 'a.js', "w.postMessage(x, '*')", 'w.postMessage(x, o)'),
    ('js-secret-public', 'a.ts', 'process.env.NEXT_PUBLIC_SECRET_KEY', 'process.env.SECRET_KEY'),
    ('svelte-raw-markup', 'a.svelte', '{@html x}', '{x}'),
    ('svelte-stored-token', 'a.svelte', "localStorage.setItem('token', t)", "localStorage.setItem('theme', t)"),
    ('html-frame-open', 'a.html', '<iframe src=x>', '<img src=x>'),
    ('html-new-window', 'a.html', "<a target='_blank' href=x>", '<a href=x>'),
    ('go-sql-built-text', 'a.go', 'db.Query(fmt.Sprintf("select %s", x))', 'db.Query("select ?", x)'),
    ('go-outbound-variable', 'a.go', 'http.Get(target)', 'http.Get("https://a.example")'),
    ('go-tls-unverified', 'a.go', 'InsecureSkipVerify: true', 'InsecureSkipVerify: false'),
    ('go-weak-random', 'a.go', 'import "math/rand"', 'import "crypto/rand"'),
    ('go-handler', 'a.go', 'r.POST("/x", h)', 'func f() {}'),
    ('go-secret-compare', 'a.go', 'if token == want {', 'if hmac.Equal(token, want) {'),
    ('go-template-raw', 'a.go', 'template.HTML(x)', 'template.New(x)'),
    ('go-path-input', 'a.go', 'p := r.URL.Query().Get("p")\nos.Open(p)', 'os.Open("a")'),
    ('java-sql-built-text', 'A.java', 's.executeQuery("select " + x);', 's.executeQuery("select 1");'),
    ('java-process', 'A.java', 'Runtime.getRuntime().exec(x);', 'run(x);'),
    ('java-object-stream', 'A.java', 'new ObjectInputStream(in)', 'new DataInputStream(in)'),
    ('java-xml-entities', 'A.java', 'DocumentBuilderFactory.newInstance();', 'Json.parse(x);'),
    ('java-cors-any', 'A.java', '@CrossOrigin("*")', '@CrossOrigin("https://a.example")'),
    ('java-token-unsigned', 'A.java', 'Algorithm.none()', 'Algorithm.HMAC256(k)'),
    ('java-outbound', 'A.java', 'new URL(target)', 'new URL("https://a.example")'),
    ('java-path-input', 'A.java', 'new File(request.getParameter(x))', 'new File("a")'),
    ('java-weak-mac', 'A.java', 'MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-256")'),
    ('java-directory-filter', 'A.java', 'ctx.search(b, "(uid=" + x + ")", c);', 'ctx.search(b, f, c);'),
    ('java-lookup-log', 'A.java', 'new InitialContext().lookup(name)', 'log.info("a")'),
    ('java-spring-route', 'A.java', '@PostMapping("/x")', 'void f() {}'),
    ('kt-sql-template', 'a.kt', 'db.rawQuery("SELECT * FROM t WHERE a = $x", null)', 'db.rawQuery("SELECT 1", null)'),
    ('kt-webview-scripts', 'a.kt', 's.javaScriptEnabled = true', 's.javaScriptEnabled = false'),
    ('kt-trust-all', 'a.kt', 'override fun checkServerTrusted(a: X, b: String) {}', 'fun f() {}'),
    ('kt-process-template', 'a.kt', 'Runtime.getRuntime().exec("ls $x")', 'list(x)'),
    ('kt-plain-preferences', 'a.kt', 'e.putString("token", t)', 'e.putString("theme", t)'),
    ('kt-global-scope', 'a.kt', 'GlobalScope.launch { }', 'scope.launch { }'),
    ('android-exported', 'AndroidManifest.xml', '<activity android:exported="true"/>', '<activity android:exported="false"/>'),
    ('c-format-variable', 'a.c', 'printf(msg);', 'printf("%s", msg);'),
    ('c-shell', 'a.c', 'system(cmd);', 'system("ls");'),
    ('c-weak-random', 'a.c', 'int k = rand();', 'int k = next();'),
    ('c-check-then-open', 'a.c', 'if (access(p, R_OK)) return;\nopen(p, 0);', 'open(p, 0);'),
    ('c-copy-length', 'a.c', 'memcpy(a, b, len);', 'memcpy(a, b, sizeof(a));'),
    ('cpp-raw-handoff', 'a.cpp', 'f(p.release());', 'f(p.get());'),
    ('rust-transmute', 'a.rs', 'std::mem::transmute(x)', 'x as u32'),
    ('rust-shell', 'a.rs', 'Command::new("sh").arg("-c")', 'Command::new("ls")'),
    ('rust-command-variable', 'a.rs', 'Command::new(&tool)', 'Command::new("ls")'),
    ('rust-sql-format', 'a.rs', 'sqlx::query(&format!("select {}", x))', 'sqlx::query("select 1")'),
    ('rust-token-unverified', 'a.rs', 'v.insecure_disable_signature_validation();', 'decode(t)'),
    ('rust-outbound-variable', 'a.rs', 'client.get(&url)', 'client.get("https://a.example")'),
    ('rust-tls-off', 'a.rs', 'b.danger_accept_invalid_certs(true)', 'b.build()'),
    ('rust-logged-secret', 'a.rs', 'info!("token {}", token);', 'info!("done");'),
    ('rust-panic-input', 'a.rs', 'x.parse::<u32>().unwrap()', 'x.parse::<u32>()?'),
    ('rust-axum-route', 'a.rs', '.route("/x", post(h))', 'fn f() {}'),
    ('rust-actix-route', 'a.rs', '#[post("/x")]', 'fn f() {}'),
    ('rb-mass-assignment', 'a.rb', 'User.new(params[:user])', 'User.new(user_params)'),
    ('rb-sql-text', 'a.rb', 'User.where("a = #{x}")', 'User.where(a: x)'),
    ('rb-yaml-load', 'a.rb', 'YAML.load(x)', 'YAML.safe_load(x)'),
    ('rb-shell', 'a.rb', 'system("ls #{x}")', 'system("ls", x)'),
    ('rb-raw-markup', 'a.rb', 'x.html_safe', 'h(x)'),
    ('rb-action', 'x_controller.rb', '  def create', '  def helper'),
    ('rb-send-input', 'a.rb', 'x.send(params[:m])', 'x.send(:m)'),
    ('php-include-input', 'a.php', "include($_GET['p']);", "include 'a.php';"),
    ('php-sql-text', 'a.php', 'mysqli_query($c, "select $_GET[x]");', 'mysqli_query($c, $q);'),
    ('php-unserialize', 'a.php', 'unserialize($x);', 'json_decode($x);'),
    ('swift-webview-scripts', 'a.swift', 'p.javaScriptEnabled = true', 'p.javaScriptEnabled = false'),
    ('swift-plain-traffic', 'Info.plist', '<key>NSAllowsArbitraryLoads</key>\n<true/>', '<key>NSAllowsArbitraryLoads</key>\n<false/>'),
    ('swift-trust-all', 'a.swift', 'completionHandler(.useCredential, URLCredential(trust: t))', 'completionHandler(.performDefaultHandling, nil)'),
    ('swift-run-script', 'a.swift', 'w.evaluateJavaScript(x)', 'w.load(x)'),
    ('swift-printed-secret', 'a.swift', 'print(token)', 'print(name)'),
    ('swift-defaults-secret', 'a.swift', 'UserDefaults.standard.set(t, forKey: "token")', 'UserDefaults.standard.set(t, forKey: "theme")'),
    ('swift-keychain-open', 'a.swift', 'kSecAttrAccessibleAlways', 'kSecAttrAccessibleWhenUnlocked'),
    ('docker-moving-tag', 'Dockerfile', 'FROM a:latest', 'FROM a:1.2'),
    ('docker-root', 'Dockerfile', 'USER root', 'USER app'),
    ('docker-piped-script', 'Dockerfile', 'RUN curl https://a.example | sh', 'RUN curl -o x https://a.example'),
    ('docker-secret-layer', 'Dockerfile', 'ENV API_TOKEN=abc', 'ENV MODE=a'),
    ('tf-any-action', 'a.tf', 'actions = ["*"]', 'actions = ["s3:GetObject"]'),
    ('tf-public-bucket', 'a.tf', 'acl = "public-read"', 'acl = "private"'),
    ('tf-open-port', 'a.tf', 'cidr_blocks = ["0.0.0.0/0"]', 'cidr_blocks = ["10.0.0.0/8"]'),
    ('k8s-privileged', 'a.yaml', 'privileged: true', 'privileged: false'),
    ('helm-loose-security', 'values.yaml', 'runAsNonRoot: false', 'runAsNonRoot: true'),
    ('ci-target-checkout', '.github/workflows/a.yml', 'on: pull_request_target\n- uses: actions/checkout@v4', 'on: push\n- uses: actions/checkout@v4'),
    ('ci-script-input', '.github/workflows/a.yml', 'run: echo ${{ github.event.issue.title }}', 'run: echo a'),
    ('rules-open-store', 'a.rules', 'allow read, write: if true;', 'allow read: if request.auth != null;'),
    ('sql-row-policy-open', 'a.sql', 'create policy p on t using (true);', 'create policy p on t using (a = b);'),
    ('any-timing-compare', 'a.py', 'if signature == expected', 'if equal(signature, expected)'),
    ('any-static-iv', 'a.py', "iv = b'0000000000000000'", 'iv = random_bytes(16)'),
    ('any-dev-bypass', 'a.py', 'if SKIP_AUTH: return', 'if auth: return'),
    ('any-debug-entry', 'a.py', "route('/debug')", "route('/home')"),
    ('any-stack-to-client', 'a.js', 'res.send(err.stack)', "res.send('failed')"),
    ('any-redirect-param', 'a.py', 'redirect(next)', "redirect('/home')"),
    ('any-secret-literal', 'a.py', "api_key = 'abcdefghijklmnop1234'", "api_key = env('KEY')"),
    ('any-token-lifetime', 'a.js', '{ignoreExpiration: true}', '{expiresIn: 60}'),
    ('any-rate-unlimited', 'a.js', "post('/login', f)", "post('/x', f)"),
    ('any-upload-name', 'a.js', 'save(file.originalname)', 'save(id)'),
    ('cs-sql-text', 'a.cs', 'new SqlCommand($"select {x}")', 'new SqlCommand("select 1")'),
    ('cs-formatter', 'a.cs', 'new BinaryFormatter()', 'JsonSerializer.Parse(x)'),
    ('ai-endless-loop', 'a.py', 'while True:\n    r = client.messages.create(x)', 'for i in range(5):\n    r = client.messages.create(x)'),
    ('ai-input-in-prompt', 'a.py', "prompt = f'do {user_input}'", "prompt = 'do this'"),
    ('ai-tool-handler', 'a.py', '@mcp.tool()\ndef f(): pass', 'def f(): pass'),
    ('ai-output-run', 'a.py', 'exec(response.text)', 'show(response.text)'),
    ('ai-remote-model-code', 'a.py', 'load(x, trust_remote_code=True)', 'load(x)'),
]


def test_every_example(spark):
    rules = {r.slug: r for r in read_packs()}
    assert len(rules) >= 140 and not {e[0] for e in EXAMPLES} - rules.keys()
    rows = [(f"{s}/{kind}/{path}", text) for s, path, hit, clean in EXAMPLES for kind, text in (("hit", hit), ("clean", clean))]
    found = scan.candidates(spark.createDataFrame(rows, "path string, content string"), [rules[e[0]] for e in EXAMPLES]).select("path", "slug").distinct().collect()
    mine = {(r.slug, r.path.split("/")[1]) for r in found if r.path.startswith(r.slug + "/")}
    assert [e[0] for e in EXAMPLES if (e[0], "hit") not in mine] == []
    assert [e[0] for e in EXAMPLES if (e[0], "clean") in mine] == []


def test_packs_are_clean():
    import tomllib

    from gritstone.rules.load import PACKS

    rows = [row for path in sorted(PACKS.glob("*.toml")) for row in tomllib.loads(path.read_text()).get("rule", [])]
    assert len({r["slug"] for r in rows}) == len(rows) and lint(rows) == []
