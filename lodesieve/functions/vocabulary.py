"""Names, words and limits that the scan of source code knows.  All are part of the results' definition."""

from __future__ import annotations

# File kinds, names, words, patterns and limits.

NAMES = "*.{ts,tsx,js,mjs,cjs,jsx}"
LEFT_OUT = r"(?:\.d\.ts|\.min\.js)$|(?:^|/)(?:node_modules|dist|build|coverage|\.[^/]+)/"
SCOPED_OUT = ["dist", "coverage", "tests", "__tests__", "pocs"]
LARGEST = 5 * 1024 * 1024
TEST_FILE = r"(?i)\.(?:test|spec)\.tsx?$|/__tests__/"
MODULE_SUFFIXES = ["", ".ts", ".tsx", ".js", "/index.ts", "/index.tsx", "/index.js"]
HOPS = 16
LOCAL_CALL_PASSES = 5

UNTRUSTED = r"(?i)\b(?:req|request)\.(?:body|query|params|headers|cookies|rawHeaders|originalUrl|url|hostname|ip|ips)\b|\bctx\.(?:request|req)\b|\b(?:userInput|userData)\b|\bsocket\.on\s*\(|\bcall\.request\b"
USER_CONTROLLED = r"(?i)(?:req|request)\.(?:params|query|body|headers|cookies)"
DECORATORS = r"@(?:Body|Param|Query|Headers|Req|Request|Args|UploadedFile|UploadedFiles|RawBody|Ip|Session|HostParam)\b"
CONSUMERS = r"^(?:on|once|addEventListener|consume|subscribe|eachMessage|eachBatch|process|handle|receive)$"
RESOLVER_KEYS = {"Query", "Mutation", "Subscription", "resolvers", "Resolvers"}
RESOLVER_ARGS = {"args", "input", "variables"}
VALIDATORS = r"^(?:parse|safeParse|validate|validateSync|sanitize|escape|stripUnknown)$"
VALIDATOR_LIBRARIES = r"(?i)joi|yup|zod|valibot|ajv|class-?validator|typebox|io-ts|whitelist|allowlist"
ONE_WAY = r"(?i)^(?:hash|hashSync|createHash|createHmac|hmac|encrypt|sign|digest|bcrypt|scrypt|pbkdf2|pbkdf2Sync|argon2|randomBytes|randomUUID|uuid|genSalt|genSaltSync)$"
BUILTINS = {
    "child_process": {"exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync", "fork"},
    "vm": {"runInThisContext", "runInNewContext", "runInContext"},
}

BOUNDARY = r"\b(?:joi|yup|zod|validator|express[-_]?validator|safe[-_]?parse|schema|allowlist|whitelist|sanitize|stripunknown|strict)\b|\b(?:pick|omit)\s*\("
URL_CHECK = r"\b(?:joi|yup|zod|valibot|ajv|express[-_]?validator|safe[-_]?parse|allowlist|whitelist|sanitize)\b|\b(?:isurl|validurl)\s*\(|\bnew\s+url\s*\(|\b(?:allowed|whitelist|valid|permitted)_[a-z0-9_]+\.has\s*\("
CONTAINED = r"\b(?:iswithin|containspath|sanitizepath|pathisinside|path-is-inside|safepath|validatepath)\b|\bpath\.resolve\s*\([^,)]*\b(?:base|root|allowed|safe|trusted)[_-]?(?:dir|path|root)\b"
TOKEN_CHECK = r"jwt\.verify|verifytoken|validatetoken|passport\.authenticate|authmiddleware|requireauth|ensureauth"
KID = r"\bkid\b"

ROUTE_HEADS = r"(?i)^(?:app|router|api|express|server|fastify|koa|hono|nest)"
CLIENT_HEADS = r"(?i)^(?:request|chai|supertest|superagent|axios|fetch|got)$"
VERBS = {"get", "post", "put", "delete", "patch", "options", "head"}
SENSITIVE_PATH = r"(?i)admin|permission|secret|apikey|password|forgot|reset|payment|billing|invoice|export|webhook|impersonate|grant|revoke"
SENSITIVE_HANDLER = r"(?i)delete|destroy|remove|update|save\(|insert|create|grant|assign|role|permission|admin|export|secret|apikey|token|password|billing|payment"
MUTATION = r"(?i)db\.|database\.|model\.|repository\.|repo\.|service\.|\.save\s*\(|\.update(?:one|many|byid)?\s*\(|\.delete(?:one|many|byid|where)?\s*\(|\.insert(?:one|many)?\s*\(|\.create(?:one|many)?\s*\(|\.remove\s*\(|\.upsert\s*\(|config\.update|setrole|grantrole|assignrole"
AUTHENTICATED = r"(?i)authmiddleware|authorizationmiddleware|requireauth|ensureauth|passport\.authenticate|jwt\.verify|verifytoken|validatetoken|authenticate|protect|guard|req\.user|currentuser|res\.locals\.user|ctx\.state\.user|request\.user"
AUTHORIZED = r"(?i)authorize|authorization|permission|role|scope|forbidden|status\(403\)|statusCode\s*=\s*403|hasrole|haspermission|canaccess|accessdenied|isadmin|requireadmin|requirerole|requirescope|requirepermission|adminonly|adminguard|withadmin|withrole"
IDENTITY = r"(?i)req\.user|currentuser|res\.locals\.user|ctx\.state\.user|request\.user"
RESOURCE = r"(?i)owner|ownerid|userid|user_id|accountid|tenantid|organizationid|orgid"
DECISION = r"(?i)===|!==|==|!=|forbidden|status\(403\)|hasrole|haspermission|canaccess|authorize"

REQUEST_TOKEN = r"(?i)\b(?:req|request)\.(?:headers|cookies|query|body|signedcookies)\b|authorization|bearer|x-access-token|getauthtoken"
TOKEN_VERIFIED = r"(?i)\bjwt\.verify\b|\bverify(?:token|jwt|signature)?\b|\bvalidate(?:token|jwt)?\b|passport\.authenticate|\bauthenticate(?:token|jwt)?\b|express-jwt|jwks"
CREDENTIAL_NAME = r"(?i)secret|password|passwd|pwd|token|apikey|api[_-]key|access[_-]?token|refresh[_-]?token|private[_-]?key|client[_-]?secret|jwt[_-]?secret|encryption[_-]?key|signing[_-]?key|cipher[_-]?key"
SENTINEL_PASSWORD = r"(?i)^(?:changeme|placeholder|example|sample|todo|none|null|undefined|password)$"
SENTINEL_SECRET = r"(?i)^(?:changeme|your[_-]?(?:secret|key|token)|placeholder|example|sample|test|todo|fix(?:me)?)(?:[_-].*)?$"
SENTINEL_KEY = r"(?i)^(?:changeme|your[_-]?(?:secret|key|token)|placeholder|example|sample|test|todo)(?:[_-].*)?$"
LABEL_WORDS = r"(?i)^[a-z]+(?:[-_][a-z]+)*$"
LABEL_PAIR = r"(?i)^[a-z]+(?:[-_][a-z]+)+$"
HEADER_NAME = r"^[A-Z][A-Za-z0-9]*(?:[-_][A-Z][A-Za-z0-9]*)+$"
X_HEADER = r"^[xX]-[A-Za-z][A-Za-z0-9-]*$"
METADATA_FIELDS = {"category", "title", "description", "recommendation", "code", "message", "error", "owaspCategory", "vulnerabilityType", "injectionType"}
SCANNER_WORDS = r"API_KEY_PATTERNS|detectHardcodedApiKeys|isDetectorLogic|extractServiceType"
SCANNER_PHRASES = [
    "secret, password, or key appears to be hardcoded", "move secrets to environment", "remove sensitive data from logs", "mask or redact passwords",
    "tokens, api keys, and pii", "sensitive data in logs", "hardcoded secret in variable", "variable contains a hardcoded secret",
]

JWT_USED = r"jsonwebtoken|\bjwt\.(?:sign|verify)\b|\bJWT\.(?:sign|verify)\b"
JWT_NAME = r"(?i)secret|signingkey|jwt|hmac"
JWT_LEAST = 32

GENERIC_CREDENTIAL = r"(?i)api[_-]?key|apikey|secret|private[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|bearer[_-]?token|client[_-]?secret|password"
#: Known service keys, in the order in which they are tried.
SERVICE_KEYS = [
    r"AKIA[0-9A-Z]{16}", r"(?i)aws_secret_access_key|aws_secret|AKIA|wJal[rRtT]|aws_access_key_id", r"sk_live_[0-9a-zA-Z]{24}", r"sk_test_[0-9a-zA-Z]{24}", r"pk_live_[0-9a-zA-Z]{24}|pk_test_[0-9a-zA-Z]{24}",
    r"AC[a-zA-Z0-9]{32}", r"(?i)twilio_auth|twilio_sid|twilio_token", r"SG\.[a-zA-Z0-9_-]{20,}", r"ghp_[a-zA-Z0-9]{36}|ghu_[a-zA-Z0-9]{36}|ghs_[a-zA-Z0-9]{36}", r"AIza[0-9A-Za-z_-]{35}",
]
#: Tried after them, on literals of credential-named places that look like secrets.
GENERIC_KEYS = r"(?i)api[_-]?key|apikey|api_key|API_KEY|api-key|secret|SECRET_KEY|secret_key|private[_-]?key"
INLINE_CREDENTIAL = r"(?i)(?:api[_-]?key|apikey|secret|token|password|client[_-]?secret)\b[^:=\n]{0,20}[:=]\s*['\"`]?([A-Za-z0-9._+=/-]{12,})"
CONFIG_FILE = r"config|\.env|settings|credentials"
CONFIG_KEY = r"(?i)\b(?:api[_-]?key|apikey|secret|access[_-]?token|refresh[_-]?token|password|passwd|pwd|client[_-]?secret|private[_-]?key|jwt[_-]?secret)\b"
ENVIRONMENT = r"(?i)process\.env|env\[|__ENV__|import\.meta\.env"
KEY_PARAMETER = r"(?i)api[_-]?key|secret|token|password"
KEY_DEFAULT = r"[\"'][\w\-.]{8,}[\"']"
TEST_PATH = r"\.test\.ts|\.spec\.ts|__tests__|test|tests|fixtures"
DOC_TAGS = r"(?i)@(?:swagger|openapi|example|api|exampleresponse|exampleobject)\b"
KEY_LOGGER = r"(?i)console\.(?:log|error|warn|info|debug)|logger\.(?:log|error|warn|info|debug|trace)|\b(?:debug|println?|printf)\b"
ERROR_WORDS = r"error|Error|exception|Exception|failed|Failed|invalid|Invalid"
CONNECTION = r"(?i)(?:mongodb|postgresql|mysql|mongodb\+srv)://[^:]+:[^@]+@"
SECRET_ENVIRONMENT = r"(?i)secret|token|key|password|passwd|pwd|credential|private[_-]?key|api[_-]?key|jwt|signing|encryption|salt|hmac|client[_-]?secret"
FALLBACK_SENTINEL = r"(?i)^(?:undefined|null|none|false|true|0)$"

ID_ACCESS = r"(?i)req\.params\..*id|req\.body\..*id|req\.query\..*id"
LOOKUP_WORDS = r"\b(?:findbyid|getbyid|findone|where|query|delete|update|select|findunique|findfirst)\b"
NOT_IDS = {"valid", "rapid", "grid", "android", "hybrid", "solid", "void", "paid", "said", "mid", "kid", "lid", "bid", "aid", "raid", "fluid", "liquid", "candid", "squid", "avoid", "overrid"}
QUERY_NAME = r"(?i)find|findById|findOne|query|select|where"
PRIVILEGED_NAME = r"(?i)^(?:admin|delete|destroy|remove|grant|revoke|impersonate|assignrole|setrole|setpermissions|escalate)"
PRIVILEGED_BODY = r"(?i)(?:req|request)\.(?:body|params|query|headers|cookies)|db\.|database\.|repository\.|repo\.|model\.|service\.|\.save\(|\.delete(?:all|many|one)?\(|\.update(?:many|one)?\(|\.insert(?:many|one)?\(|\.create(?:many|one)?\("
DIRECT_LOOKUP = r"(?i)findById|getById|getOne|findOne"
DIRECT_LOOKUP_NAME = r"(?i)^(?:findById|getById|getOne|findOne)$"
SERVICE_RECEIVER = r"(?i)(?:service|repository|repo|dao|store|manager|provider|gateway|datasource)$"
SERVICE_VERB = r"(?i)^(?:get|find|fetch|load|read|retrieve|lookup|select|delete|remove|update|patch|modify|edit)"
OWNER_CONTEXT = r"(?i)\b(?:req\.user|currentuser|user[_-]?id|owner|owner[_-]?id|tenant|tenant[_-]?id|org[_-]?id|organization[_-]?id|account[_-]?id)\b"

LIMITED_PATHS = ["/login", "/register", "/forgot-password", "/api/admin", "/api/keys", "/api/secrets", "/api/export"]
HIGH_RISK_PATH = r"(?i)login|auth|admin|password|secret|key"
LIMITER_NAME = r"(?i)ratelimit|ratelimiter|limiter|throttle|throttler"
ADDRESS_KEY = r"req\.ip|request\.ip|x-forwarded-for|x-real-ip|x-client-ip|cf-connecting-ip"
TRUSTED_KEY = r"trustedproxies|trust proxy|isinternalnetwork|getclientip|proxy-addr|req\.user|currentuser|res\.locals\.user|ctx\.state\.user|request\.user|\.user\?\.id|\.user\.id|user\?\.\w+|user\.\w+"
MEMORY_STORE = r"memorystore|memory"
SHARED_STORE = r"redis|redisstore|memcached|cluster|storeclient"
MOST_PER_MINUTE = 10

BL_ASYNC = r"async\s+function|async\s*\(|async\s*=>"
BL_LOCKS = ["transaction", "lock", "mutex"]
PAYMENT_ROUTE = r"charge|payment|checkout|purchase|refund|billing|invoice|stripe|order"
IDEMPOTENT = r"idempotency|idempotentkey|requestid|duplicate|dedupe|processed[_-]?request"
PAYMENT_CALL = r"stripe\.charges\.create|charges\.create|createcharge|paymentintent|payments?\.create|checkout"
PAYMENT_WORD = r"charge|payment"
AMOUNT_KEY = r"amount|price|total|unitamount|unit_amount"
AMOUNT_ARGUMENT = r"amount|price|total"
FUNDS_WORDS = ["balance", "funds", "account"]
FUNDS_ACTS = ["update", "debit", "withdraw", "query"]
STOCKED = r"(?i)balance|funds?|stock|quantity|inventory|wallet|credits?|points|available"
STOCK_ACT = r"(?i)debit|withdraw|decrement|deduct|charge|transfer|reserve|reduce|subtract|increment|update|save|set"
STOCK_READ = r"(?i)get|find|select|fetch|read|current|load|lookup|balance|count"
ATOMIC = r"(?i)transaction|\.lock\(|for\s+update|mutex|semaphore|serializable|findoneandupdate|\$inc|\batomic\b|optimistic|pessimistic|rowlock|version\s*:|\.increment\(|\.decrement\(|\btx\b|\btrx\b|queryrunner|unitofwork"
INVENTORY = r"quantity|stock|inventory"
INVENTORY_LOCKS = r"transaction|lock|for update|mutex|semaphore"
INVENTORY_READ = r"select|find|findone|get|query"
INVENTORY_WRITE = r"update|decrement|adjust|save|query"
INVENTORY_CHANGE = r"-|decrement|set\s+quantity\s*=|set\s+stock\s*="
INVENTORY_GUARD = r"where[\s\S]*quantity\s*>=|where[\s\S]*stock\s*>=|and quantity|and stock|affectedrows|rowcount"

PROTOTYPE_GUARD = r"(?i)__proto__|constructor|prototype|hasownproperty|object\.create\(\s*null\s*\)|new map\(|\.set\("
MERGES = r"(?i)^(?:merge|mergeWith|deepMerge|deepmerge|extend|defaultsDeep|assignInWith|setWith)$"
SAVE_VERB = r"^(?:create|update|save|insert|upsert|register|new)(?:[A-Z]|$)"
SAVE_RECEIVER = r"(?i)(?:service|repo|repository|model|dao|store|client|controller|resource|entity)$"
RAW_BODY = r"^(?:req|request)\.body$|^ctx\.request\.body$"
BODY_VALIDATED = r"(?i)\b(?:joi|yup|zod|valibot|ajv|class-?validator|express[-_]?validator|safe[-_]?parse|sanitize)\b"
BODY_PICKED = r"const\s*\{[^}]+\}\s*=\s*(?:req|request)\.body"
BODY_CHOSEN = r"(?i)\b(?:pick|omit|extract)\s*\("
RAW_REQUEST = r"^(?:req|request|ctx\.request)\.(?:body|query|params)$"
SENSITIVE_FIELD = r"(?i)\b(?:role|roles|isadmin|admin|permission|permissions|scope|scopes|verified|isverified|active|status|balance|price|amount|credit|owner|ownerid|userid|tenantid|approved|enabled|level|tier|plan|grant)\b"
REQUEST_OBJECT = r"^(?:req|request|res|response|ctx)\b"
COPY_WORDS = ["Object.assign", "Object.entries", "spread operator", "...object"]
ALLOW_WORDS = ["whitelist", "allowed", "permitted", "blacklist"]
PROTOTYPE_TARGET = r"__proto__|constructor\.prototype|\.prototype\["
PROTOTYPE_KEYS = {"constructor", "__proto__", "prototype"}

QUEUE_HANDLERS = r"^(?:on|once|consume|subscribe|listen|process|eachmessage|eachbatch|handle|receive)$"
QUEUE_PARSERS = r"JSON\.parse|eval\(|new\s+Function|\bdeserialize\b|\bunserialize\b|node-serialize"
QUEUE_MESSAGE = r"\b(?:msg|message|payload|body|data|record|content|value|event)\b"
QUEUE_VALIDATED = r"(?i)\b(?:validate|verify|schema|joi|yup|zod|ajv|safeParse|parseAsync)\b"
QUEUE_SEND = r"^(?:publish|send|sendmessage|sendtoqueue|enqueue|produce|emit)$"
QUEUE_RECEIVER = r"\b(?:queue|channel|producer|topic|exchange|kafka|sqs|sns|rabbit|amqp|broker|bus|stream|pubsub|publisher|mq|nats|bull|kue|jetstream|eventbridge)\b"
QUEUE_REQUEST = r"(?i)\b(?:req|request)\.(?:body|query|params)\b"
QUEUE_SIGNED = r"(?i)\b(?:auth|verify|token|signature|hmac|sign)\b"
BROKER = r"(?i)amqp|kafka|sqs|rabbitmq"
ACKNOWLEDGED = r"\.ack|\.nack|\.nak"
BROKER_MESSAGE = r"msg|message|payload"
BROKER_CHECKED = r"signature|hmac|verify|checksum"
EVENT_HANDLER = r"(?i)\.on\(|\.addEventListener|\.subscribe|EventEmitter|event\.subscribe|pub\.on"
EVENT_DATA = r"(?i)req\.(?:body|query|params|headers)|request\.(?:body|query|params|headers)"
EVENT_CHECKED = r"(?i)validate|sanitize|escape|filter|schema|joi|yup|zod"
EVENT_SEND = r"\.emit|\.fire|eventbus\.publish|eventemitter\.publish"
EVENT_NAME = r"(?i)req\.(?:query|params|body)|request\.(?:query|params|body)|user\."
TENANT_HANDLERS = r"^(?:on|once|subscribe|addlistener)$"
TENANT_RECEIVER = r"\b(?:socket|io|emitter|eventemitter|bus|eventbus|stream|channel|subscriber|pubsub|ws|wss|connection|conn)\b"
TENANT_STORE = r"(?i)\b(?:db|database|model|models|repo|repository|prisma|knex|sequelize|collection)\b\s*\.\s*\w"
TENANT_DATA = r"(?i)\b(?:user|account|profile|order|payment|billing|invoice|wallet|balance|transaction)\b"
TENANT_SCOPE = r"(?i)\b(?:tenantId|tenant|orgId|organisation|organization|workspace|accountId|ownerId|scope)\b"

SESSION_COOKIE = r"(?i)(?:^|[._-])(?:sess|session|sid|sso|auth|token|jwt|refresh|access|login|remember|csrf|xsrf)"
SECRET_NAME = r"(?i)signature|\bsig\b|hmac|digest|\bmac\b|\bhash\b|token|secret|otp|\bnonce\b|csrf|checksum|expectedhash|computedhash"
HASHED = r"(?i)createHmac|createHash|\.digest\(|\.sign\(|crypto\."
SECURITY_WORDS = r"(?i)password|secret|sign|token|hmac|integrity|auth|credential|session|cookie|csrf"
WEAK_HASH = r"(?i)^(?:md5|sha1)$"
ONE_TIME = r"(?i)session|sessionid|nonce|reset(?:code|token)?|otp|csrf|recovery|invitation|invite|share|magiclink|verif(?:y|ication)?code|resetcode|tempkey"
KEY_LITERAL = r"(?:key|secret)\s*[:=]\s*['\"][A-Za-z0-9]{10,}['\"]"
EXPOSED = r"\.(?:password|token|secret|apiKey|creditCard|ssn)\s*[,}]"
REMOVED = r"delete\s+\w+\.(?:password|token|secret|apiKey|creditCard|ssn)|\.\.\.rest|omit\(|pick\("
SENT_USER = r"res\.send\(|res\.json\(|\breturn\s+.*\buser\b"
RESPONSE = r"(?i)(?:\bres|\bresponse|\breply|\bctx\.body|\bctx\.response)\.(?:send|json|status|end|render|attachment|download)\s*\("
RESPONSE_BUILDER = r"(?i)(?:response|dto|payload|serialize|present|view|render|tojson)$|^(?:build|make|create|format|to)\w*(?:response|dto|payload|view|json)"
REQUEST_KEY = r"(?i)\b(?:req|request)\.(?:headers|query|params|url|originalUrl|cookies)\b"
CLEAN_KEY = r"(?i)\b(?:sanitize|validate|normalize|encodeURIComponent|createHash|hmac|sha\d|allowlist|whitelist)\b"
HEADER_KEY = r"(?i)\b(?:host|referer|referrer|user-?agent|x-forwarded-for|x-forwarded-host|x-original-url|forwarded)\b"
REQUEST_HEADERS = r"(?i)\b(?:req|request)\.headers\b"
CACHE_WRITE = r"^(?:set|put|store|setex|hset|mset|add)$"
CACHE_RECEIVER = r"\b(?:cache|rediscache|memcache|memcached|kv|store|cacheclient)\b"
REDIS_WRITE = r"^(?:set|put|setex)$"
OUTBOUND = r"(?i)^(?:fetch|axios|got|ky|needle|request|superagent|undici|phin)$|^(?:axios|got|ky|needle|http|https|client|httpClient|api|apiClient|agent|instance|svc|service|gateway|upstream)\.(?:get|post|put|delete|patch|head|request|stream)$"
FILE_CALL = r"^(?:readFile|readFileSync|writeFile|writeFileSync|appendFile|appendFileSync|createReadStream|createWriteStream|unlink|unlinkSync|stat|statSync|lstat|lstatSync|sendFile|download)$|\.(?:readFile|readFileSync|writeFile|writeFileSync|appendFile|appendFileSync|createReadStream|createWriteStream|sendFile|download)$"
SQL_CALL = r"(?i)^(?:query|execute|raw|exec|run|all|get|prepare)$"
DATABASE = r"(?i)\b(?:db|database|conn|connection|pool|client|sql|knex|sqlite|pg|postgres|mysql|mariadb|mssql|sequelize|tx|trx|transaction|repo|repository|datasource|prisma)\b"
SQL_WORDS = r"(?i)\b(?:select|insert|update|delete|from|where|join|having|union)\b"
SEARCH_RECEIVER = r"(?i)\b(?:db|database|repo|repository|model|query)\b"
SEARCH_TERMS = r"(?i)query|filter|term|search"
NOSQL = r"(?i)^(?:find|findOne|findOneAndUpdate|findOneAndReplace|findOneAndDelete|findById|findByIdAndUpdate|update|updateOne|updateMany|deleteOne|deleteMany|remove|count|countDocuments|aggregate|distinct)$"
MODEL = r"^[A-Z][A-Za-z0-9_]*$|\.(?:collection|model)\s*\(|(?i:\b(?:db|database|mongo|mongoose|model|models|collection|repository|repo)\b)"
NOSQL_SAFE = r"^(?:String|Number|parseInt|parseFloat|Boolean)\(|^['\"`\d]"
NOSQL_CODE = r"\$(?:where|function)\b|mapReduce"
RAW = r"(?i)^(?:whereRaw|havingRaw|orderByRaw|groupByRaw|joinRaw|fromRaw|selectRaw|queryRawUnsafe|executeRawUnsafe|where|andWhere|orWhere|having|andHaving|orHaving)$"
MAPPER = r"(?i)\b(?:knex|qb|queryBuilder|builder|trx|tx|db|database|repository|repo|datasource|manager|entityManager|connection|conn|sequelize|prisma)\b|createQueryBuilder|getRepository|\$queryRaw|\$executeRaw"
ENGINES = r"^(?:handlebars|hbs|Handlebars|pug|jade|ejs|nunjucks|_|lodash|dot|doT|eta|Eta|mustache|Mustache|twig|liquid|Liquid|art|template)$"
TEMPLATE_CALL = r"(?i)^(?:compile|compileFile|renderString|template)$"
XML_OPTIONS = r"(?i)^(?:noent|resolveExternals|replaceEntities|externalEntities|loadExternalDtd)$"
PROCESS = r"(?i)^(?:exec|execSync|spawn|spawnSync|fork|execFile|execFileSync)$"
GADGETS = r"^(?:Object\.create|Object\.defineProperty|Object\.defineProperties|Object\.setPrototypeOf|Reflect\.set|Reflect\.defineProperty)$"
SQL_TAG = r"^(?:sql|SQL|db\.sql|slonik\.sql|raw|knex\.raw|prisma\.\$queryRaw(?:Unsafe)?|pgPromise\.as)$"
REFLECTED = r"(?i)\breq(?:uest)?\.headers\.origin\b|\breq(?:uest)?\.header\(\s*['\"]origin"
REFLECTED_CALLBACK = r"(?i)\b(?:callback|cb|done)\s*\(\s*null\s*,\s*(?:true|origin)\s*\)"
ORIGIN_CHECKED = r"(?i)includes|indexOf|===|!==|allowlist|whitelist|\.test\(|\.some\("
ORIGIN_HEADER = r"(?i)access-control-allow-origin"
CREDENTIALS_HEADER = r"(?i)access-control-allow-credentials"
HEADER_TRUE = r"(?i)['\"]true['\"]|,\s*true\s*\)"
LOG_NAMES = r"(?i)^(?:console|logger|log|winston|pino)$|\b(?:logger|log)$"
LOG_VERBS = r"^(?:log|debug|info|warn|error|trace|fatal)$"
SENSITIVE_LOG = r"(?i)\bpassword\b|\bpwd\b|\bpasswd\b|\bapi[_-]?key\b|\bapikey\b|\bsecret\b|\btoken\b|\baccess[_-]?token\b|\brefresh[_-]?token\b|\bbearer\s+[\w\-.]+\b|\bauthorization\b|\bauth\s*:|\bcredit[_-]?card\b|\bccnum\b|\bccnumber\b|\bssn\b|\bsocial[_-]?security\b|\bprivate[_-]?key\b|\bcertificate\b"
LOGGED_REQUEST = r"\b(?:req|request)\."
BODY_PARSERS = {"json", "urlencoded", "raw", "text"}
BODY_PARSER_OWNERS = r"(?i)^(?:express|bodyParser|body_parser|app)$"
BCRYPT = r"(?i)^(?:bcrypt|bcryptjs)$"
LEAST_COST = 10
FALSY = r"(?i)^(?:false|0+(?:\.0*)?|['\"`]\s*(?:0|false)?\s*['\"`])$"
TLS_SWITCH = r"^process\.env(?:\.NODE_TLS_REJECT_UNAUTHORIZED|\[['\"`]NODE_TLS_REJECT_UNAUTHORIZED['\"`]\])$"

# End of fixed values.
